"""Command line: one command for each application, tables as Parquet paths."""

from __future__ import annotations

import argparse
import time
from datetime import datetime

from wayfold.functions import grader, tagger
from wayfold.params import Density
from wayfold.operators import anomaly
from wayfold.operators.cluster import CELL, grid_cells
from wayfold.plans import apps
from wayfold.session import build_session
from wayfold.sources.files import save_counted
from wayfold.sources.placed import Curve, PlacedTable
from wayfold.streaming.ticks import ClusterStore, cluster_messages, replay

COMMANDS: dict[str, tuple[tuple[str, ...], object]] = {
    "ingest-volumes": (("volume_csv", "layout_csv", "point_csv", "line_csv"), lambda s, a: apps.ingest_volumes(s, a.volume_csv, a.layout_csv, a.point_csv, a.line_csv)),
    "ingest-points": (("messages",), lambda s, a: apps.ingest_points(s, a.messages, grader.Grader.load(s, a.grader) if a.grader else None, lemmas=tagger.Tagger.load(s, a.tagger) if a.tagger else None)),
    "baseline": (("volumes",), lambda s, a: apps.build_baseline(s.read.parquet(a.volumes))),
    "nearby-baseline": (("sites", "points"), lambda s, a: apps.build_nearby_baseline(s.read.parquet(a.sites), s.read.parquet(a.points))),
    "rush-hour": (("baseline",), lambda s, a: apps.rush_hour(s.read.parquet(a.baseline))),
    "clustered-by-hour": (("points",), lambda s, a: apps.count_clustered_by_hour(s.read.parquet(a.points))),
    "on-street": (("points", "lines"), lambda s, a: apps.flag_on_street(s.read.parquet(a.points), s.read.parquet(a.lines))),
    "site-anomalies": (("volumes", "baseline", "points", "nearby"), lambda s, a: apps.detect_site_anomalies(*(s.read.parquet(p) for p in (a.volumes, a.baseline, a.points, a.nearby)))),
    "cluster-anomalies": (("points", "volumes", "baseline"), lambda s, a: apps.detect_cluster_anomalies(*(s.read.parquet(p) for p in (a.points, a.volumes, a.baseline)))),
    "abnormal-share": (("anomalies",), lambda s, a: anomaly.share_with_any(s.read.parquet(a.anomalies))),
    "summarise-clusters": (("points",), lambda s, a: apps.summarise_clusters(s.read.parquet(a.points))),
    "cluster": (("points",), lambda s, a: apps.cluster_points(s.read.parquet(a.points), density(a), most=a.max_pts)),
    "cells": (("points",), lambda s, a: grid_cells(s.read.parquet(a.points), density(a), a.max_pts, within=top_cell(a))),
}


def density(args: argparse.Namespace) -> Density:
    return Density(args.min_pts, args.km, round(args.minutes * 60_000))


def top_cell(args: argparse.Namespace) -> dict[str, tuple[float, float]] | None:
    return {"x": (args.top_cell[0], args.top_cell[2]), "y": (args.top_cell[1], args.top_cell[3])} if args.top_cell else None


def with_cells(parser: argparse.ArgumentParser, most: int) -> None:
    parser.add_argument("--max-pts", type=int, default=most, help="points of a cell")
    parser.add_argument("--top-cell", type=float, nargs=4, metavar=("LON1", "LAT1", "LON2", "LAT2"), help="the extent to halve, if it is larger than that of the points")


def with_density(parser: argparse.ArgumentParser) -> None:
    usual = Density()
    parser.add_argument("--min-pts", type=int, default=usual.min_points)
    parser.add_argument("--km", type=float, default=usual.km)
    parser.add_argument("--minutes", type=float, default=usual.ms / 60_000)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="wayfold")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (inputs, _) in COMMANDS.items():
        p = commands.add_parser(name)
        for x in inputs:
            p.add_argument(f"--{x.replace('_', '-')}", required=True)
        p.add_argument("--out", required=True)
        p.add_argument("--overwrite", action="store_true")
        if name in ("cluster", "cells"):
            with_density(p)
            with_cells(p, 700 if name == "cells" else CELL)
        if name == "ingest-points":
            p.add_argument("--grader", help="what fit-grader wrote; adds sentiment, and words as tokens")
            p.add_argument("--tagger", help="what fit-tagger wrote; adds lemmas as tokens")
    p = commands.add_parser("store-points", help="append points to a table laid out by place and time")
    for x in ("points", "store"):
        p.add_argument(f"--{x}", required=True)
    p.add_argument("--box", type=float, nargs=4, default=Curve.box, metavar=("LON1", "LAT1", "LON2", "LAT2"), help="where most points are")
    p.add_argument("--file-rows", type=int, default=1_000_000)
    p.add_argument("--compact", action="store_true")
    p = commands.add_parser("find-points", help="read a box and a span of such a table")
    for x in ("store", "out"):
        p.add_argument(f"--{x}", required=True)
    p.add_argument("--box", type=float, nargs=4, metavar=("LON1", "LAT1", "LON2", "LAT2"))
    p.add_argument("--begin", type=datetime.fromisoformat)
    p.add_argument("--end", type=datetime.fromisoformat)
    p.add_argument("--overwrite", action="store_true")
    p = commands.add_parser("fit-grader", help="learn to grade sentences from Parquet rows (text, grade of 0 to 4)")
    for x in ("sample", "out"):
        p.add_argument(f"--{x}", required=True)
    p = commands.add_parser("fit-tagger", help="learn tags and lemmas from Parquet rows (sentence, place, word, tag, lemma)")
    for x in ("marked", "out"):
        p.add_argument(f"--{x}", required=True)
    p = commands.add_parser("replay", help="send the messages of a folder on at a pace")
    for x in ("folder", "target", "checkpoint"):
        p.add_argument(f"--{x}", required=True)
    p.add_argument("--seconds", type=float, default=1, help="between two ticks; 0 sends all and ends")
    p.add_argument("--files", type=int, default=1, help="a tick")
    p.add_argument("--format", default="log")
    p = commands.add_parser("cluster-stream")
    for x in ("source", "store", "checkpoint"):
        p.add_argument(f"--{x}", required=True)
    p.add_argument("--format", default="text")
    p.add_argument("--interval-sec", type=int)
    p.add_argument("--overwrite", action="store_true")
    with_density(p)
    with_cells(p, 700)
    args = parser.parse_args(argv)
    spark, began = build_session(f"wayfold {args.command}"), time.time()
    if args.command == "cluster-stream":
        if args.overwrite:
            ClusterStore(spark, args.store).drop()
        cluster_messages(spark, args.source, args.store, args.checkpoint, density(args), args.interval_sec, args.format, args.max_pts, top_cell(args)).awaitTermination()
    elif args.command == "fit-grader":
        grader.fit(spark.read.parquet(args.sample)).save(spark, args.out)
    elif args.command == "fit-tagger":
        tagger.fit(spark.read.parquet(args.marked)).save(spark, args.out)
    elif args.command == "replay":
        replay(spark, args.folder, args.target, args.checkpoint, args.seconds, args.files, args.format).awaitTermination()
    elif args.command == "store-points":
        table = PlacedTable(spark, args.store, Curve(tuple(args.box)), args.file_rows)
        n = table.append(spark.read.parquet(args.points))
        if args.compact:
            table.compact()
        print(f"store-points: {n} rows")
    elif args.command == "find-points":
        table, box = PlacedTable(spark, args.store), tuple(args.box) if args.box else None
        met, every = table.files(box, args.begin, args.end)
        n = save_counted(table.read(box, args.begin, args.end), args.out, "overwrite" if args.overwrite else "append")
        print(f"find-points: {n} rows from {len(met)} of {every} files")
    else:
        n = save_counted(COMMANDS[args.command][1](spark, args), args.out, "overwrite" if args.overwrite else "append")
        print(f"{args.command}: {n} rows")
    print(f"{args.command}: {time.time() - began:.1f} s")


if __name__ == "__main__":
    main()
