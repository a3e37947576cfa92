"""Equi-joins of two point tables with exact counts before anything is built."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.values import is_blank
from ..session import checkpoint, hint_if_small
from ..table import DATE, NUMBER, STRING, PointTable, unique_name
from .ordering import with_position

# Fixed values.
PREVIEW_ROWS = 8
#: A key with more than the square of this many pairs is joined in blocks, of at least so many rows of the left side.
BLOCK_ROWS = 1024
#: Blocks that are wanted before they hold more left rows, and the most that they then hold; larger ones mean fewer copies of right rows.
BLOCKS, MOST_ROWS = 256, 16_384
#: Right rows of a block: a list that each left row meets, so that the columns of the pairs repeat soon. A multiple of eight,
#: as dictionary numbers are packed eight at a time.
LIST_ROWS = 512
BLOCK = ("key", "lparts_at", "rparts_at")
#: Pairs that a task makes of blocks, and the most tasks planned for that.
TASK_PAIRS, MAX_TASKS = 16_000_000, 10_000


@dataclass(frozen=True)
class JoinOptions:
    """Which attributes match and which columns the result carries."""

    left_field: str
    right_field: str
    mode: str = "inner"
    max_rows: int | None = None  # no limit
    left_name: str = "Dataset 1"
    right_name: str = "Dataset 2"
    left_columns: Sequence[str] | None = None
    right_columns: Sequence[str] | None = None
    left_id: bool = True
    right_id: bool = True
    right_coordinates: bool = True


def check_join(left: PointTable, right: PointTable, options: JoinOptions) -> None:
    """Refuse a join that cannot work, before any job."""
    if options.mode not in ("inner", "left"):
        raise ValueError(f"mode is inner or left, not {options.mode!r}")
    most = options.max_rows
    if most is not None and (isinstance(most, bool) or not isinstance(most, int) or most < 1):
        raise ValueError("max_rows: expected None or a whole number of at least 1")
    if left.field(options.left_field).kind != right.field(options.right_field).kind:
        raise ValueError(f"{options.left_field} and {options.right_field} are of different kinds")


def join_key(table: PointTable, name: str) -> Column:
    """The value two rows match on; blank text and missing values never match."""
    c, kind = table.col(name), table.field(name).kind
    if kind == STRING:
        return F.when(~is_blank(c), c)
    if kind == DATE:
        return F.unix_millis(c.cast("timestamp"))
    # Numbers keep their own type, so big integers stay exact and 0.0 meets -0.0; what is not finite meets nothing.
    if kind == NUMBER and dict(table.df.dtypes)[name] in ("double", "float"):
        return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)
    return c


def key_counts(table: PointTable, name: str) -> DataFrame:
    """Rows per key, combined before the shuffle so that a hot key is one row per task."""
    return table.df.groupBy(join_key(table, name).alias("k")).agg(F.count(F.lit(1)).alias("n"))


def join_report(left: PointTable, right: PointTable, options: JoinOptions) -> DataFrame:
    """Exact row counts of a join, from key counts of both sides and never from pairs."""
    check_join(left, right, options)
    l = key_counts(left, options.left_field).withColumnRenamed("n", "ln")
    r = key_counts(right, options.right_field).withColumnRenamed("n", "rn")
    # Null keys meet only themselves here, because a full join keeps both sides' rows apart.
    both = l.join(r, "k", "full")
    key = F.col("k").isNotNull()
    ln, rn = F.coalesce("ln", F.lit(0)), F.coalesce("rn", F.lit(0))
    matched = key & (ln > 0) & (rn > 0)
    kept = F.when(matched, ln * rn)
    if options.mode == "left":
        kept = kept.when(ln > 0, ln)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return both.agg(
        total(ln).alias("left_rows"), total(rn).alias("right_rows"),
        total(F.when(matched, ln)).alias("matched_left"), total(F.when(~matched, ln)).alias("unmatched_left"),
        total(F.when(~key, ln)).alias("missing_left"), total(F.when(~key, rn)).alias("missing_right"),
        F.count_if(key & (rn > 1)).alias("duplicate_right_keys"), total(kept).alias("output_rows"))


# --- result columns -------------------------------------------------------

@dataclass(frozen=True)
class _Side:
    """One side of a join: its table, its name in headers, and what it brings."""

    key: str
    table: PointTable
    title: str
    columns: Sequence[str] | None
    id: bool
    coordinates: bool

    def attributes(self) -> list[tuple[str, str, str, str]]:
        wanted = None if self.columns is None else list(self.columns)
        if wanted is not None and (len(wanted) > len(set(wanted)) or not all(map(self.table.has, wanted))):
            raise ValueError(f"The {self.key} side lists a column twice or one that it does not have")
        return [(self.key, f.name, f"{self.title}.{f.name}", f.kind) for f in self.table.fields if wanted is None or f.name in wanted]

    def identity(self) -> list[tuple[str, str, str, str]]:
        return [(self.key, self.table.id, f"{self.title}.@id", STRING)] if self.id else []

    def place(self) -> list[tuple[str, str, str, str]]:
        columns = ((self.table.lon, "longitude"), (self.table.lat, "latitude")) if self.coordinates else ()
        return [(self.key, c, f"{self.title}.@{name}", NUMBER) for c, name in columns]


def join_schema(left: PointTable, right: PointTable, options: JoinOptions) -> list[tuple[str, str, str, str]]:
    """Result columns as ``(side, source column, result name, kind)``: attributes, ids, places; each left first."""
    titles = [name.strip() or f"Dataset {i}" for i, name in enumerate((options.left_name, options.right_name), 1)]
    if titles[0] == titles[1]:
        titles[1] += " (2)"
    sides = (_Side("left", left, titles[0], options.left_columns, options.left_id, True),
             _Side("right", right, titles[1], options.right_columns, options.right_id, options.right_coordinates))
    taken: list[str] = []
    out = []
    for side, source, wanted, kind in [c for part in (_Side.attributes, _Side.identity, _Side.place) for s in sides for c in part(s)]:
        taken.append(unique_name(wanted, taken))
        out.append((side, source, taken[-1], kind))
    return out


def _side(table: PointTable, name: str, prefix: str, columns: Sequence[str]) -> DataFrame:
    """Only the columns a join needs, under names that cannot clash."""
    picked = [table.col(c).alias(f"{prefix}{i}") for i, c in enumerate(columns)]
    return table.df.select(join_key(table, name).alias("k"), table.col(table.row).alias(f"{prefix}row"), *picked)


def _shown(rows: DataFrame, schema, extra: Sequence[str] = ()) -> DataFrame:
    """Joined rows in the columns of the result."""
    numbers = {"left": iter(range(len(schema))), "right": iter(range(len(schema)))}
    shown = [F.col(f"{'l' if side == 'left' else 'r'}{next(numbers[side])}").alias(name) for side, _, name, _ in schema]
    return rows.select("lrow", "rrow", *extra, *shown)


def _joined(l: DataFrame, r: DataFrame, mode: str, schema, extra: Sequence[str] = ()) -> DataFrame:
    return _shown(l.join(r, "k", mode), schema, extra)


def _sides(left: PointTable, right: PointTable, options: JoinOptions, schema) -> tuple[DataFrame, DataFrame]:
    l = _side(left, options.left_field, "l", [c for s, c, _, _ in schema if s == "left"])
    r = _side(right, options.right_field, "r", [c for s, c, _, _ in schema if s == "right"]).where("k is not null")
    return l, r


def _heavy_keys(l: DataFrame, r: DataFrame) -> DataFrame:
    """Keys with more pairs than a block holds: a number, their rows of each side, and their pairs."""
    count = lambda rows, name: rows.groupBy("k").agg(F.count(F.lit(1)).alias(name))
    both = count(l, "ln").join(count(r, "rn"), "k").where(F.col("ln") * F.col("rn") > BLOCK_ROWS ** 2)
    return checkpoint(both.select("k", F.monotonically_increasing_id().alias("key"), "ln", "rn", (F.col("ln") * F.col("rn")).alias("pairs")))


def _left_blocks(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """Left rows of heavy keys, dealt to parts by their hash and copied to each list of the right side."""
    hashed = [c for c, t in rows.dtypes if "map<" not in t and "variant" not in t]
    part = F.pmod(F.xxhash64(*hashed), F.col("lparts")).cast("int")
    dealt = rows.join(heavy, "k").withColumn("lparts_at", part)
    return dealt.withColumn("rparts_at", F.explode(F.sequence(F.lit(0), F.col("rparts") - 1))).drop("k", "lparts", "rparts")


def _right_blocks(rows: DataFrame, heavy: DataFrame, keys: int, ranked: bool) -> DataFrame:
    """Right rows of heavy keys as lists of ``LIST_ROWS`` in a row, copied to each part of the left side."""
    dealt = rows.join(heavy, "k").drop("k", "rparts")
    if not ranked:
        dealt = with_position(dealt, [F.col("key"), F.asc_nulls_first("rrow")], "__rank")
        first = hint_if_small(dealt.groupBy("key").agg(F.min("__rank").alias("__from")), keys)
        dealt = dealt.join(first, "key").withColumn("__rank", F.col("__rank") - F.col("__from"))
    carried = F.struct("__rank", *[c for c in rows.columns if c not in ("k", "__rank")])
    # By rank alone, as other columns may be of kinds without an order.
    by_rank = lambda a, b: F.when(a["__rank"] < b["__rank"], -1).otherwise(1)
    lists = dealt.groupBy("key", "lparts", F.floor(F.col("__rank") / F.lit(LIST_ROWS)).cast("int").alias("rparts_at")).agg(
        F.array_sort(F.collect_list(carried), by_rank).alias("list"))
    return lists.withColumn("lparts_at", F.explode(F.sequence(F.lit(0), F.col("lparts") - 1))).drop("lparts")


def _left_rows(pairs: int) -> int:
    """Left rows of a block: as many as leave enough blocks for many tasks."""
    return max(BLOCK_ROWS, min(MOST_ROWS, pairs // (BLOCKS * LIST_ROWS)))


def _pairs(l: DataFrame, r: DataFrame, mode: str, schema, extra: Sequence[str] = ()) -> DataFrame:
    """Joined rows of two sides, see :func:`join_rows`; ``extra`` are the place of a left row and the rank of a right row in its key."""
    keyed = l.where("k is not null")
    heavy = _heavy_keys(keyed, r)
    keys, pairs = heavy.agg(F.count(F.lit(1)), F.sum("pairs")).first()
    if keys:
        parts = lambda n, rows: F.ceil(F.col(n) / F.lit(rows)).cast("int")
        heavy = hint_if_small(heavy.select("k", "key", parts("ln", _left_rows(pairs)).alias("lparts"), parts("rn", LIST_ROWS).alias("rparts")), keys)
        # A fixed number of tasks, as few rows give many pairs and would be gathered in few tasks.
        files = max(int(l.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-pairs // TASK_PAIRS), MAX_TASKS))
        lrows, lists = (rows.repartition(files, *BLOCK) for rows in (_left_blocks(keyed, heavy), _right_blocks(r, heavy, keys, bool(extra))))
        met = lrows.join(lists.hint("merge"), list(BLOCK))
        blocks = _shown(met.select(*[c for c in l.columns if c != "k"], F.inline("list")), schema, extra)
        light = [rows.join(heavy.select("k"), "k", "left_anti") for rows in (keyed, r)]
        matched = _joined(*light, mode, schema, extra).unionByName(blocks)
    else:
        matched = _joined(keyed, r, mode, schema, extra)
    if mode == "inner":
        return matched
    nothing = {n: t for n, t in r.dtypes if n != "k"}
    alone = l.where("k is null").select("*", *[F.lit(None).cast(t).alias(n) for n, t in nothing.items()])
    return matched.unionByName(_shown(alone, schema, extra))


def join_rows(left: PointTable, right: PointTable, options: JoinOptions) -> DataFrame:
    """All matching pairs, plus unmatched left rows in ``left`` mode.

    Keys with many rows on both sides are counted first and joined in blocks of bounded size, so their
    pairs come from many tasks however small the tables are. For all other keys the strategy is left to
    AQE: it broadcasts a side that turns out small and splits the partitions of hot keys. Rows without a
    key are joined to nothing, so in ``left`` mode they skip the shuffle instead of meeting in one task.
    """
    check_join(left, right, options)
    schema = join_schema(left, right, options)
    return _pairs(*_sides(left, right, options, schema), options.mode, schema)


def placed_join_rows(left: PointTable, right: PointTable, options: JoinOptions, name: str) -> DataFrame:
    """:func:`join_rows` numbered 0, 1, 2, … in left order, then right order; no pair is sorted.

    A left row's first number is the sum of the pairs of all left rows before it, and a pair's place behind
    that is the place of its right row among the rows of its key. Only pairs of row ids that occur more than
    once on the left are put in order themselves.
    """
    check_join(left, right, options)
    schema = join_schema(left, right, options)
    l, r = _sides(left, right, options, schema)
    right_order = F.asc_nulls_first("rrow")
    r = with_position(r, [F.col("k"), right_order], "__rank")
    keys = r.groupBy("k").agg(F.count(F.lit(1)).alias("__n"), F.min("__rank").alias("__from"))
    r = r.join(keys.select("k", "__from"), "k").withColumn("__rank", F.col("__rank") - F.col("__from")).drop("__from")
    alone = 1 if options.mode == "left" else 0
    counted = l.join(keys.select("k", "__n"), "k", "left").withColumn("__n", F.coalesce("__n", F.lit(alone)))
    l = with_position(counted, [F.asc("lrow")], "__begin", F.col("__n")).drop("__n")
    again = checkpoint(l.groupBy(F.col("lrow").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("__begin").alias("__first"))
                       .where("n > 1").drop("n"))
    rows = again.count()
    again = hint_if_small(again, rows)
    once = l.join(again, F.col("lrow").eqNullSafe(F.col("id")), "left_anti") if rows else l
    extra = ("__begin", "__rank")
    place = F.col("__begin") + F.coalesce("__rank", F.lit(0))
    placed = _pairs(once, r, options.mode, schema, extra).withColumn(name, place).drop(*extra)
    if not rows:
        return placed
    repeated = l.join(again, F.col("lrow").eqNullSafe(F.col("id")), "left_semi")
    ordered = with_position(_pairs(repeated, r, options.mode, schema), [F.asc("lrow"), right_order], "__place")
    firsts = ordered.groupBy(F.col("lrow").alias("other")).agg(F.min("__place").alias("__least"))
    shift = (again.join(firsts, F.col("id").eqNullSafe(F.col("other")))
             .select("id", (F.col("__first") - F.col("__least")).alias("__shift")))
    moved = (ordered.join(shift, F.col("lrow").eqNullSafe(F.col("id")))
             .withColumn(name, F.col("__place") + F.col("__shift")).drop("__place", "__shift", "id"))
    return placed.unionByName(moved)


def join_inner(left: PointTable, right: PointTable, options: JoinOptions) -> DataFrame:
    return join_rows(left, right, replace(options, mode="inner"))


def join_left(left: PointTable, right: PointTable, options: JoinOptions) -> DataFrame:
    return join_rows(left, right, replace(options, mode="left"))


def _first_per_key(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows of each key; Spark limits each task before the shuffle."""
    w = Window.partitionBy("k").orderBy(order)
    return rows.withColumn("at", F.row_number().over(w)).where(F.col("at") <= n).drop("at")


def join_preview(left: PointTable, right: PointTable, options: JoinOptions, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first joined rows in left order, then right order, without building the join.

    The first n results use at most the first n left rows that have a result, and for
    each of them at most the first n right rows of its key.
    """
    check_join(left, right, options)
    schema = join_schema(left, right, options)
    l, r = _sides(left, right, options, schema)
    if options.mode == "inner":
        candidates = _first_per_key(l.where("k is not null"), "lrow", rows)
        keys = r.select("k").distinct()
        l = candidates.join(keys, "k", "left_semi")
    first_left = checkpoint(l.orderBy("lrow").limit(rows))  # a handful of rows, used twice below
    # At most n keys, so broadcasting them is bounded.
    near = r.join(F.broadcast(first_left.select("k").where("k is not null").distinct()), "k", "left_semi")
    first_right = _first_per_key(near, "rrow", rows)
    return (_joined(first_left, first_right, options.mode, schema)
            .orderBy("lrow", F.asc_nulls_first("rrow")).limit(rows))


def join_guard(report: DataFrame, options: JoinOptions) -> int:
    """Stop before writing when the counted result is empty or too large."""
    rows = report.first()["output_rows"]
    if rows == 0:
        raise ValueError("No keys match, so the result would have no rows")
    if options.max_rows is not None and rows > options.max_rows:
        raise ValueError(f"The result has {rows:,} rows, above the {options.max_rows:,} row limit of max_rows")
    return rows


def _place(id: Column) -> tuple[Column, Column]:
    """The word that holds a row id's bit, and the number of the bit."""
    return F.shiftright(id.cast("long"), 6), id.cast("long").bitwiseAND(F.lit(63)).cast("int")


def row_bits(rows: DataFrame, row: str = "row") -> DataFrame:
    """A row set as bits, ``__word`` and ``__bits``: one row says which of 64 ids in a row belong to it.

    Words are combined before the shuffle. A dense set takes two bits per row of its table, a sparse
    one 16 bytes per member. Repeated ids count once, missing ids are left out.
    """
    word, bit = _place(F.col(row))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    return rows.where(F.col(row).isNotNull()).groupBy(word.alias("__word")).agg(F.bit_or(one).alias("__bits"))


def semi_applied(table: PointTable, rows: DataFrame, predicate: Column | None = None, row: str = "row") -> DataFrame:
    """Rows of a row set that are also in the current selection.

    The set is computed once, as bits in the checkpoint folder. A set of few words is broadcast and
    the table stays where it is; a word joins at most once, so no row is repeated.
    """
    base = table.df if predicate is None else table.df.where(predicate)
    bits = checkpoint(row_bits(rows, row))
    word, bit = _place(table.col(table.row))
    met = base.join(hint_if_small(bits, bits.count()), word == F.col("__word"))
    return met.where(F.call_function("bit_get", F.col("__bits"), bit) == 1).drop("__word", "__bits")


intersect_rows = semi_applied
