"""Every query against its SQL in DuckDB, on one of the small tables."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from wayfold.operators import cluster
from wayfold.params import Density
from wayfold.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).partition('.')[0]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_its_sql(spark, sf, duck, name):
    found = catalogue.QUERIES[name](spark, sf)
    told = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in told.description]
    columns, expected = rows_of(names, told.fetchall())
    own_columns, own = rows_of(found.columns, [tuple(r) for r in found.collect()])
    assert own_columns == columns
    assert len(own) == len(expected)
    assert own == expected
    assert own or name in ("site_anomalies", "cluster_anomalies", "cluster_interval_join", "two_sigma", "baseline_lookup", "exists_near_line")


def test_cells_hold_every_point_once_apart_from_halos(spark, sf):
    points = catalogue.pv(spark, sf)
    own = cluster.grid_cells(points, Density(min_points=0), 50).where("not halo")
    assert own.count() == own.select("obj_id").distinct().count() == points.count()
    assert own.groupBy("cell").count().agg(F.max("count")).first()[0] <= 50
