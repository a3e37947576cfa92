"""Browsing records: search, typed sort, pages and single records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import natural_key, search_text, value_text
from ..table import BOOLEAN, DATE, NUMBER, STRING, PointTable
from .joins import semi_applied
from .ordering import with_position, with_rank

# Fixed values.
MAX_PAGE = 100
CHOICE_PAGE = 30
SOURCE, ID, LONGITUDE, LATITUDE = "@source", "@id", "@longitude", "@latitude"
#: Up to this depth a page is a distributed top-k; deeper pages read a written order.
TOP_K_ROWS = 100_000


def record_column(table: PointTable, key: str) -> tuple[Column, str]:
    """A reserved or ordinary record column with its kind."""
    if key == SOURCE:
        return F.lit(table.name), STRING
    if key == ID:
        return table.col(table.id), STRING
    if key in (LONGITUDE, LATITUDE):
        return table.col(table.lon if key == LONGITUDE else table.lat), NUMBER
    return table.col(key), table.field(key).kind


def records_search(table: PointTable, search: str) -> Column:
    """Case-insensitive substring over the id, the coordinates and every value."""
    needle = search.strip().lower()
    if not needle:
        return F.lit(True)
    columns = [record_column(table, k) for k in (ID, LONGITUDE, LATITUDE)]
    columns += [(table.col(f.name), f.kind) for f in table.fields]
    return reduce(Column.__or__, [F.contains(F.lower(search_text(c, kind)), F.lit(needle)) for c, kind in columns])


def records_order(table: PointTable, sort: str = "", descending: bool = False) -> list[Column]:
    """Sort columns: missing values last both ways, ties in load order."""
    row = table.col(table.row).asc()
    if not sort or sort == SOURCE:
        return [row]
    c, kind = record_column(table, sort)
    key = natural_key(value_text(c, kind)) if kind in (STRING, BOOLEAN) else c
    return [key.desc_nulls_last() if descending else key.asc_nulls_last(), row]


def ranked(rows: DataFrame, text: Column) -> DataFrame:
    """Rows with ``__rank``, which orders them as the natural key of ``text`` does.

    Comparing under a locale is slow, so only distinct texts are put in order by it; rows are then ordered by a number.
    """
    ranks = with_rank(rows.select(text.alias("__text")).where(F.col("__text").isNotNull()).distinct(),
                      natural_key(F.col("__text")), "__rank")
    return rows.withColumn("__text", text).join(ranks, "__text", "left").drop("__text")


def ranked_order(table: PointTable, rows: DataFrame, sort: str = "", descending: bool = False) -> tuple[DataFrame, list[Column]]:
    """Rows to be sorted as a whole and their :func:`records_order`, in which texts stand for their ranks in ``__rank``."""
    order = records_order(table, sort, descending)
    if len(order) == 1:
        return rows, order
    c, kind = record_column(table, sort)
    if kind not in (STRING, BOOLEAN):
        return rows, order
    key = F.col("__rank")
    return ranked(rows, value_text(c, kind)), [key.desc_nulls_last() if descending else key.asc_nulls_last(), order[-1]]


def records_sort(table: PointTable, sort: str = "", descending: bool = False, search: str = "",
                 predicate: Column | None = None) -> DataFrame:
    """All matching records in order."""
    return matching(table, search, predicate).orderBy(*records_order(table, sort, descending))


def matching(table: PointTable, search: str = "", predicate: Column | None = None) -> DataFrame:
    rows = table.df if predicate is None else table.df.where(predicate)
    return rows.where(records_search(table, search))


def records_total(table: PointTable, search: str = "", predicate: Column | None = None) -> int:
    return matching(table, search, predicate).count()


def page_start(total: int, offset: int) -> int:
    """An offset held inside the result."""
    return max(0, min(offset, total - 1))


def records_page(table: PointTable, offset: int, limit: int = MAX_PAGE, sort: str = "", descending: bool = False,
                 search: str = "", predicate: Column | None = None, shallow: int = TOP_K_ROWS) -> tuple[DataFrame, int]:
    """One page of records and the total. Pages up to the ``shallow``-th row are a distributed top-k."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"A page has 1 to {MAX_PAGE} records")
    total = records_total(table, search, predicate)
    start = page_start(total, offset)
    if start + limit <= shallow:
        return records_sort(table, sort, descending, search, predicate).offset(start).limit(limit), total
    return _rows_at(table, start, limit, sort, descending, search, predicate), total


def _rows_at(table: PointTable, start: int, count: int, sort: str, descending: bool, search: str, predicate: Column | None) -> DataFrame:
    """Records from a position on. Only sort keys and row ids are put in order; at most a page is joined back."""
    row = table.col(table.row)
    keys = records_order(table, sort, descending)[:-1]
    value = record_column(table, sort)[0] if keys else F.lit(None).cast("string")
    narrow = matching(table, search, predicate).select(row.alias("__row"), value.alias("__value"))
    kind = record_column(table, sort)[1] if keys else STRING
    if keys:
        key = F.col("__value")
        if kind in (STRING, BOOLEAN):
            narrow, key = ranked(narrow, value_text(key, kind)), F.col("__rank")
        keys = [key.desc_nulls_last() if descending else key.asc_nulls_last()]
    placed = with_position(narrow, [*keys, F.col("__row").asc()])
    page = placed.where(F.col("position").between(start, start + count - 1)).select("__row", "position")
    return table.df.join(F.broadcast(page), row == F.col("__row")).orderBy("position").drop("__row", "position")


def records_index(table: PointTable, sort: str = "", descending: bool = False, search: str = "",
                  predicate: Column | None = None) -> DataFrame:
    """Records with their dense position; write it once to serve any page cheaply."""
    rows, order = ranked_order(table, matching(table, search, predicate), sort, descending)
    return with_position(rows, order).drop("__rank")


def record_at(table: PointTable, n: int, sort: str = "", descending: bool = False, search: str = "",
              predicate: Column | None = None, shallow: int = TOP_K_ROWS) -> DataFrame:
    """The n-th record of an order."""
    if n + 1 <= shallow:
        return records_sort(table, sort, descending, search, predicate).offset(n).limit(1)
    return _rows_at(table, n, 1, sort, descending, search, predicate)


def choice_page(table: PointTable, predicate: Column, page: int = 0) -> DataFrame:
    """Matches to choose from, thirty at a time in load order."""
    ordered = table.df.where(predicate).orderBy(table.col(table.row))
    return ordered.offset(page * CHOICE_PAGE).limit(CHOICE_PAGE)


def load_limit(table: PointTable, limit: int, shallow: int = TOP_K_ROWS) -> PointTable:
    """The first rows of a load, in load order."""
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
        raise ValueError("A limit is a whole number of at least 1")
    row = table.col(table.row)
    if limit <= shallow:
        return table.with_df(table.df.orderBy(row).limit(limit))
    # Row ids alone are put in order; the last one that is let in becomes a filter.
    ids = with_position(table.df.select(row.alias("__row")), [F.col("__row")])
    last = ids.where(F.col("position") == limit - 1).select("__row").first()
    return table if last is None else table.with_df(table.df.where(row <= F.lit(last[0])))


def sorted_domain(table: PointTable, name: str, search: str = "") -> DataFrame:
    """Distinct text values in order, optionally only those containing a text."""
    c = table.col(name)
    values = table.df.where(c.isNotNull()).select(c.alias("value")).distinct()
    if search:
        values = values.where(F.contains(F.lower("value"), F.lit(search.lower())))
    return values.orderBy("value")


def get_records(table: PointTable, rows: Sequence[int] | DataFrame) -> DataFrame:
    """Full typed records by row id, from a short list or a row-set DataFrame."""
    if isinstance(rows, DataFrame):
        return semi_applied(table, rows, row=rows.columns[0])
    return table.df.where(table.col(table.row).isin(*rows))


def records_json(table: PointTable, df: DataFrame | None = None) -> DataFrame:
    """Records as typed JSON text: source, id, coordinates and properties."""
    properties = [(value_text(table.col(f.name), DATE) if f.kind == DATE else table.col(f.name)).alias(f.name)
                  for f in table.fields]
    body = F.struct(F.lit(table.name).alias("source"), table.col(table.id).alias("id"),
                    F.array(table.col(table.lon), table.col(table.lat)).alias("coordinates"),
                    F.struct(*properties).alias("properties"))
    return (table.df if df is None else df).select(
        table.col(table.row).alias("row"), F.to_json(body, {"ignoreNullFields": "false"}).alias("record"))


def record_texts(table: PointTable, df: DataFrame | None = None) -> DataFrame:
    """Every value of a record as search text."""
    shown = [search_text(table.col(f.name), f.kind).alias(f.name) for f in table.fields]
    return (table.df if df is None else df).select(table.col(table.row).alias("row"), *shown)
