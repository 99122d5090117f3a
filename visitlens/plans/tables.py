"""The derived tables that the registered queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import enrich, read_models, rollups
from ..sources import events

NOW = "2024-01-31T00:00:00"
START, END = "2024-01-01T00:00:00", "2024-01-31T00:00:00"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.raw_events(spark, sf_dir)


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enrich_events(raw(spark, sf_dir), NOW)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.facts(enriched(spark, sf_dir))


def day_rollups(spark: SparkSession, sf_dir: str, level: str | None = "GLOBAL") -> DataFrame:
    return rollups.event_rollups(enriched(spark, sf_dir), "1d", level)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_models.build_sessions(facts(spark, sf_dir))


def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_models.funnel_steps(enriched(spark, sf_dir))


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.geo_centroid(raw(spark, sf_dir))
