"""Checks on loaded pages and tables: what fails a load and what is only reported."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.geo import coordinates_ok, is_clamped
from ..table import PointTable, quote
from .ellipses import EllipseConfig, has_ellipse


class LoadError(ValueError):
    """A load that must not be used."""


def duplicate_ids(table: PointTable) -> DataFrame:
    """Ids that occur more than once; missing ids are exempt."""
    id = table.col(table.id)
    return (table.df.where(id.isNotNull()).groupBy(id.alias("id")).agg(F.count(F.lit(1)).alias("count"))
            .where(F.col("count") > 1))


def check_duplicate_ids(table: PointTable) -> None:
    """Fail the load on the first repeated id."""
    found = duplicate_ids(table).limit(1).collect()
    if found:
        raise LoadError(f"Repeated feature ID {found[0]['id']}: pages overlap, so the service needs a sort field that is stable")


def page_signatures(features: DataFrame, page: str, order: str, columns: Sequence[str]) -> DataFrame:
    """First and last feature of every page, combined before the shuffle."""
    body = F.sha2(F.to_json(F.struct(*[F.col(quote(c)) for c in columns])), 256)
    return features.groupBy(page).agg(F.min_by(body, order).alias("first"), F.max_by(body, order).alias("last"),
                                      F.count(F.lit(1)).alias("features"))


def repeated_pages(signatures: DataFrame, page: str) -> DataFrame:
    """Pages whose first and last feature equal those of the page before."""
    # One row per page: a page holds thousands of features, so this is a small table.
    order = Window.orderBy(page)
    return (signatures.select(page, F.struct("first", "last").alias("now"))
            .withColumn("before", F.lag("now").over(order)).where(F.col("now") == F.col("before")).select(page))


def check_repeated_page(signatures: DataFrame, page: str) -> None:
    found = repeated_pages(signatures, page).limit(1).collect()
    if found:
        raise LoadError(f"Page {found[0][page]} repeats the one before it; offsets are not supported")


def page_overruns(signatures: DataFrame, page: str, requested: str | int) -> DataFrame:
    """Pages with more features than were asked for."""
    most = F.lit(requested) if isinstance(requested, int) else F.col(requested)
    return signatures.where(F.col("features") > most).select(page, "features")


def check_page_overrun(signatures: DataFrame, page: str, requested: str | int) -> None:
    found = page_overruns(signatures, page, requested).limit(1).collect()
    if found:
        raise LoadError(f"Page {found[0][page]} ignored the requested count")


def schema_drift(features: DataFrame, properties: str, known: Sequence[str]) -> DataFrame:
    """Attributes outside the schema, from a ``map<string, …>`` or variant column."""
    kind = dict(features.dtypes)[properties]
    names = F.map_keys(properties) if kind.startswith("map") else F.expr(
        f"map_keys(cast({quote(properties)} as map<string,variant>))")
    return (features.select(F.explode(F.array_except(names, F.array(*[F.lit(k) for k in known]).cast("array<string>")))
                            .alias("attribute")).distinct())


def check_schema_drift(features: DataFrame, properties: str, known: Sequence[str]) -> None:
    found = schema_drift(features, properties, known).limit(1).collect()
    if found:
        raise LoadError(f"A new attribute appeared after the first page: {found[0]['attribute']}")


def bad_coordinates(table: PointTable) -> DataFrame:
    """Rows outside finite WGS84 degrees."""
    return table.df.where(~coordinates_ok(table.col(table.lon), table.col(table.lat)))


def check_coordinates(table: PointTable) -> None:
    found = bad_coordinates(table).select(table.col(table.lon).alias("lon"), table.col(table.lat).alias("lat")).limit(1).collect()
    if found:
        raise LoadError(f"Outside the globe: longitude {found[0]['lon']}, latitude {found[0]['lat']}")


def clamp_report(table: PointTable) -> DataFrame:
    """Points the map can only show at its latitude limit; stored values are kept."""
    return table.df.agg(F.count_if(is_clamped(table.col(table.lat))).alias("clamped"))


def missing_id_warning(table: PointTable) -> DataFrame:
    """Whether duplicate detection is limited by features without an id."""
    return table.df.agg(F.coalesce(F.bool_or(table.col(table.id).isNull()), F.lit(False)).alias("missing_ids"))


def truncation_flag(table: PointTable, limit: int | None) -> DataFrame:
    """Whether the load stopped at its limit and is therefore incomplete; without a limit it did not."""
    stopped = F.lit(False) if limit is None else F.col("loaded") == limit
    return table.df.agg(F.count(F.lit(1)).alias("loaded")).select("loaded", stopped.alias("truncated"))


def dataset_bounds(table: PointTable) -> DataFrame:
    """Extreme coordinates."""
    lon, lat = table.col(table.lon), table.col(table.lat)
    return table.df.agg(F.min(lon).alias("west"), F.min(lat).alias("south"), F.max(lon).alias("east"), F.max(lat).alias("north"))


def union_bounds(bounds: Sequence[DataFrame]) -> DataFrame:
    """Bounds that cover several tables."""
    return reduce(DataFrame.unionByName, bounds).agg(F.min("west").alias("west"), F.min("south").alias("south"),
                                                     F.max("east").alias("east"), F.max("north").alias("north"))


def load_report(table: PointTable, limit: int | None, ellipses: EllipseConfig | None = None) -> DataFrame:
    """Everything that is counted after a load, in one scan; with ellipses also the rows that have none."""
    invalid = [F.count_if(~has_ellipse(table, ellipses)).alias("invalid_ellipses")] if ellipses else []
    lon, lat, id = (table.col(c) for c in (table.lon, table.lat, table.id))
    loaded = F.count(F.lit(1))
    return table.df.agg(
        loaded.alias("loaded"), (F.lit(False) if limit is None else loaded == limit).alias("truncated"), F.count_if(is_clamped(lat)).alias("clamped"),
        F.coalesce(F.bool_or(id.isNull()), F.lit(False)).alias("missing_ids"), F.min(lon).alias("west"),
        F.min(lat).alias("south"), F.max(lon).alias("east"), F.max(lat).alias("north"), *invalid)
