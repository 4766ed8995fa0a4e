"""Session construction with the settings that every plan here relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "wayfold", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` overrides single settings (dots as `__`)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
