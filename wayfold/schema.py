"""Schemas, as DDL, of the stored tables and of what is ingested."""

from __future__ import annotations

#: A geo-tagged message as it arrives.
MESSAGE = "id_str string, text string, coordinates struct<type: string, coordinates: array<double>>, created_at string, user struct<screen_name: string>, lang string, tokens array<string>, sentiment int"
#: A stored message.
POINTS = "obj_id string, ts timestamp, lon double, lat double, text string, screen_name string, tokens array<string>, sentiment int, day_of_week string, sec_of_day long, cluster_id string, cluster_label string"
VOLUMES = "site string, detector string, interval_ts timestamp, volume int, day_of_week string, lon double, lat double, road array<struct<lon1: double, lat1: double, lon2: double, lat2: double>>, location string, general string, lane string, lane_mvt string, loc_mvt string, flow string"
BASELINE = "site string, day_of_week string, time_of_day string, average double, n long, deviation double, low double, high double"
NEARBY = "site string, day_of_week string, hour int, average double, n long, deviation double, low double, high double"
