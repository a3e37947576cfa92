"""Full-table domains, and axes whose bins are also exact filters.

A domain is a handful of numbers, so it is collected once and its bin edges become
literals. The bin expression and the predicate of a bin use the same doubles, which
is what makes ``rows in the predicate == count of the bin`` hold for every bin.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scales import LINEAR, LOG10, check_scale, scale_value, unscale_value
from ..functions.values import iso_from_millis, literal_text, short_number, shown_from_millis
from ..table import BOOLEAN, DATE, NUMBER, STRING, PointTable, quote, sql_number, sql_text
from .expressions import and_, or_, rule

# Fixed values.
TOP_CATEGORIES = 23
MAX_BINS = 64
MAX_SHARED_LABELS = 63
OTHER = "Other categories"


@dataclass(frozen=True)
class Domain:
    """What an axis needs to know about one attribute of the full table."""

    kind: str
    min: float | None = None
    max: float | None = None
    min_positive: float | None = None
    max_positive: float | None = None
    labels: tuple[str, ...] = ()
    more: bool = False

    @property
    def empty(self) -> bool:
        return self.min is None


# --- profiles -------------------------------------------------------------

def measure_sql(table: PointTable, name: str) -> str:
    """The attribute as a double: dates in epoch milliseconds, booleans as 0 and 1."""
    c, kind = quote(name), table.field(name).kind
    if kind == DATE:
        return f"CAST(unix_millis(CAST({c} AS TIMESTAMP)) AS DOUBLE)"
    return f"CAST(CAST({c} AS INT) AS DOUBLE)" if kind == BOOLEAN else f"CAST({c} AS DOUBLE)"


def measure(table: PointTable, name: str) -> Column:
    return F.expr(measure_sql(table, name))


def profile_numeric(table: PointTable, names: Sequence[str]) -> DataFrame:
    """Extremes of number, date and boolean attributes: one scan, one row per attribute."""
    sums, rows = [], []
    for i, name in enumerate(names):
        v = measure_sql(table, name)
        positive = f"FILTER (WHERE {v} > 0)"
        sums += [F.expr(f"min({v}) AS min_{i}"), F.expr(f"max({v}) AS max_{i}"), F.expr(f"min({v}) {positive} AS minp_{i}"),
                 F.expr(f"max({v}) {positive} AS maxp_{i}")]
        rows.append(f"struct({sql_text(name)} AS field, '{table.field(name).kind}' AS kind, min_{i} AS min, max_{i} AS max, "
                    f"minp_{i} AS min_positive, maxp_{i} AS max_positive)")
    return table.df.agg(*sums).selectExpr(f"inline(array({', '.join(rows)}))")


def category_counts(table: PointTable, names: Sequence[str]) -> DataFrame:
    """Count and first row of every value of the given text attributes, in one scan."""
    pairs = ", ".join(f"struct({sql_text(n)} AS field, {quote(n)} AS value)" for n in names)
    return (table.df.selectExpr(f"{quote(table.row)} AS at", f"inline(array({pairs}))").where("value IS NOT NULL")
            .groupBy("field", "value").agg(F.expr("count(1) AS count"), F.expr("min(at) AS first_row")))


def profile_categories(table: PointTable, names: Sequence[str], top: int = TOP_CATEGORIES) -> DataFrame:
    """The most frequent values per attribute, ties in order of first appearance.

    The rank limit is applied before the shuffle as well, so wide domains stay cheap.
    """
    counts = category_counts(table, names)
    order = (F.desc("count"), F.asc("first_row"))
    if len(names) == 1:
        # One attribute is a plain distributed top-k; only its few rows are then numbered.
        counts = counts.orderBy(*order).limit(top)
    best = Window.partitionBy("field").orderBy(*order)
    return (counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
            .select("field", "rank", "value", "count"))


def chart_domains(table: PointTable, names: Iterable[str]) -> dict[str, Domain]:
    """Domains of several attributes; known ones come from the table's memory.

    One job runs for all of them: an aggregate of numeric attributes beside a ranked
    count of text attributes. At most 24 rows per attribute return to the driver.
    """
    wanted = list(dict.fromkeys(names))
    new = [n for n in wanted if n not in table.domains]
    numeric = [n for n in new if table.field(n).kind != STRING]
    text = [n for n in new if table.field(n).kind == STRING]
    parts = []
    if numeric:
        parts.append(profile_numeric(table, numeric).withColumns({"rank": F.lit(None).cast("int"), "value": F.lit(None).cast("string")}))
    if text:
        nothing = {n: F.lit(None).cast("double") for n in ("min", "max", "min_positive", "max_positive")}
        parts.append(profile_categories(table, text, TOP_CATEGORIES + 1).drop("count").withColumns({"kind": F.lit(STRING), **nothing}))
    found: dict[str, list] = {n: [] for n in text}
    for r in reduce(DataFrame.unionByName, parts).collect() if parts else ():
        if r["kind"] == STRING:
            found[r["field"]].append((r["rank"], r["value"]))
        else:
            table.domains[r["field"]] = Domain(r["kind"], r["min"], r["max"], r["min_positive"], r["max_positive"])
    for n, ranked in found.items():
        labels = tuple(v for _, v in sorted(ranked))
        table.domains[n] = Domain(STRING, labels=labels[:TOP_CATEGORIES], more=len(labels) > TOP_CATEGORIES)
    return {n: table.domains[n] for n in wanted}


def chart_domain(table: PointTable, name: str) -> Domain:
    return chart_domains(table, [name])[name]


def shared_domain(domains: Sequence[Domain]) -> Domain:
    """The union of domains of one kind, for axes shared by several tables."""
    if not domains or any(d.kind != domains[0].kind for d in domains):
        raise ValueError("The attributes of a shared axis are of different kinds")

    def extreme(pick, values):
        present = [v for v in values if v is not None]
        return pick(present) if present else None

    labels = tuple(sorted({v for d in domains for v in d.labels})[:MAX_SHARED_LABELS])
    return Domain(domains[0].kind, extreme(min, [d.min for d in domains]), extreme(max, [d.max for d in domains]),
                  extreme(min, [d.min_positive for d in domains]), extreme(max, [d.max_positive for d in domains]),
                  labels, more=domains[0].kind == STRING)


# --- axes -----------------------------------------------------------------

@dataclass(frozen=True)
class Axis:
    """Bins of one attribute. ``bin`` and ``predicate`` agree on every row."""

    field: str
    kind: str
    labels: tuple[str, ...] = ()
    edges: tuple[float, ...] = ()
    scale: str = LINEAR
    values: tuple[str, ...] = ()
    other: bool = False

    @property
    def size(self) -> int:
        return len(self.labels)

    @property
    def ranged(self) -> bool:
        return bool(self.edges)

    def for_field(self, name: str) -> "Axis":
        """The same bins over another attribute (another table of a shared axis)."""
        return replace(self, field=name)

    # rows -> bins

    def bin(self, table: PointTable) -> Column:
        """Bin number of each row, null when the row has no place on the axis."""
        return F.expr(self.bin_sql(table))

    def bin_sql(self, table: PointTable) -> str:
        """The same as one SQL expression: a chart then is a single parsed text."""
        c = quote(self.field)
        if self.size == 0:
            return "CAST(NULL AS INT)"
        if self.kind == BOOLEAN:
            return f"CAST({c} AS INT)"
        if self.kind != STRING:
            return self._range_sql(measure_sql(table, self.field))
        if not self.values:
            return f"CASE WHEN {c} IS NOT NULL THEN 0 END"
        # A position of 0 means the value is not listed, and null that it is missing.
        place = f"CAST(array_position(array({', '.join(map(sql_text, self.values))}), {c}) AS INT)"
        return f"COALESCE(NULLIF({place}, 0), CASE WHEN {c} IS NOT NULL THEN {len(self.values) + 1} END) - 1"

    def _range_sql(self, v: str) -> str:
        n = self.size
        present = f"{v} > 0" if self.scale == LOG10 else f"{v} IS NOT NULL"
        if n == 1:
            return f"CASE WHEN {present} THEN 0 END"
        low, high = (scale_value(e, self.scale) for e in (self.edges[0], self.edges[-1]))
        width = (high - low) / n
        if not self._estimate_is_safe(low, high, width):
            # Bins too narrow or too wide for arithmetic: count the edges passed.
            passed = " + ".join(f"CAST({v} >= {sql_number(e)} AS INT)" for e in self.edges[1:-1])
            return f"CASE WHEN {present} THEN {passed} END"
        hold = lambda text: f"CAST(GREATEST(0L, LEAST({n - 1}L, {text})) AS INT)"
        at = f"LOG10({v})" if self.scale == LOG10 else v
        guess = hold(f"FLOOR(({at} - {sql_number(low)}) / {sql_number(width)})")
        if self.scale == LOG10:
            edges = f"array({', '.join(map(sql_number, self.edges))})"
            lower, upper = f"element_at({edges}, {guess} + 1)", f"element_at({edges}, {guess} + 2)"
        else:
            edge = f"({sql_number(low)} + {sql_number(width)} * {{}})"
            edge = f"CAST(CEIL({edge}) AS DOUBLE)" if self.kind == DATE else edge
            lower, upper = edge.format(guess), edge.format(f"({guess} + 1)")
        # Rounding can put the guess one bin off; the shared edges decide.
        exact = hold(f"{guess} - CAST({v} < {lower} AS INT) + CAST({v} >= {upper} AS INT)")
        return f"CASE WHEN {present} THEN {exact} END"

    def _estimate_is_safe(self, low: float, high: float, width: float) -> bool:
        """True when the guessed bin is provably at most one bin off."""
        if not (math.isfinite(width) and width > 0):
            return False
        if self.scale == LOG10:
            return width > 1e-9
        return self.kind == DATE or width > 16 * math.ulp(max(abs(low), abs(high)))

    # bins -> predicates

    def predicate(self, index: int) -> dict:
        """The filter that selects exactly the rows counted in one bin."""
        return self.interval(index, index)

    def interval(self, first: int, last: int) -> dict:
        """A run of bins as one filter: a range, or an OR of labels."""
        if not 0 <= first <= last < self.size:
            raise ValueError("Unknown bin")
        if self.ranged:
            end = "lte" if last == self.size - 1 else "lt"
            return and_(rule(self.field, "gte", self._literal(self.edges[first])),
                        rule(self.field, end, self._literal(self.edges[last + 1])))
        parts = [self._label_rule(i) for i in range(first, last + 1)]
        return parts[0] if len(parts) == 1 else or_(*parts)

    def _label_rule(self, index: int) -> dict:
        if self.kind == BOOLEAN:
            return rule(self.field, "eq", self.labels[index])
        if index < len(self.values):
            return rule(self.field, "eq", self.values[index])
        return rule(self.field, "notin", values=list(self.values))

    def _literal(self, edge: float) -> str:
        return iso_from_millis(int(edge)) if self.kind == DATE else literal_text(edge)


def build_axis(name: str, domain: Domain, bins: int = 24, scale: str = LINEAR, shared: bool = False) -> Axis:
    """Bins over a domain. A shared text axis always ends in the catch-all bin."""
    check_scale(scale)
    if isinstance(bins, bool) or not isinstance(bins, int) or not 2 <= bins <= MAX_BINS:
        raise ValueError("Invalid chart configuration")
    if scale == LOG10 and domain.kind != NUMBER:
        raise ValueError("Only numbers have a logarithmic axis")
    if domain.kind == STRING:
        other = shared or domain.more
        return Axis(name, STRING, (*domain.labels, *([OTHER] if other else [])), values=domain.labels, other=other)
    if domain.kind == BOOLEAN:
        return Axis(name, BOOLEAN, ("false", "true"))
    low, high = (domain.min_positive, domain.max_positive) if scale == LOG10 else (domain.min, domain.max)
    if low is None:
        return Axis(name, domain.kind, scale=scale)
    edges = bin_edges(low, high, bins, domain.kind, scale)
    shown = (lambda v: shown_from_millis(int(v))) if domain.kind == DATE else short_number
    if len(edges) == 2:
        labels: tuple[str, ...] = (shown(low),)
    else:
        labels = tuple(f"{shown(a)} – {shown(b)}" for a, b in zip(edges, edges[1:]))
    return Axis(name, domain.kind, labels, edges, scale)


def bin_edges(low: float, high: float, bins: int, kind: str = NUMBER, scale: str = LINEAR) -> tuple[float, ...]:
    """Equal bins on the scale, pinned to the domain ends; one bin for a constant."""
    n = 1 if low == high else bins
    a, b = scale_value(low, scale), scale_value(high, scale)
    width = (b - a) / n
    steady = scale == LINEAR and math.isfinite(width) and width > 0
    inner = []
    for i in range(1, n):
        if scale == LOG10:
            edge = unscale_value(a * (1 - i / n) + b * (i / n), scale)
        else:
            edge = low + width * i if steady else low * (1 - i / n) + high * (i / n)
        inner.append(float(math.ceil(edge)) if kind == DATE else edge)
    return (low, *inner, high)


def axis_for(table: PointTable, name: str, bins: int = 24, scale: str = LINEAR) -> Axis:
    """Axis over the full table, whatever the current filter."""
    return build_axis(name, chart_domain(table, name), bins, scale)


def axis_table(table: PointTable, axis: Axis) -> DataFrame:
    """The bins as rows: number, label and edges."""
    rows = [(i, label, float(axis.edges[i]) if axis.ranged else None, float(axis.edges[i + 1]) if axis.ranged else None)
            for i, label in enumerate(axis.labels)]
    return table.df.sparkSession.createDataFrame(rows, "bin int, label string, lower double, upper double")


# --- predicates over several bins -----------------------------------------

def cell_predicate(x: Axis, y: Axis | None, first: tuple[int, int], last: tuple[int, int]) -> dict:
    """A rectangle of cells: the x interval AND the y interval."""
    (x0, y0), (x1, y1) = first, last
    across = x.interval(min(x0, x1), max(x0, x1))
    return across if y is None else and_(across, y.interval(min(y0, y1), max(y0, y1)))


def segments_predicate(axis: Axis, bins: Iterable[int]) -> dict:
    """A set of bins as an OR of its longest runs."""
    runs: list[list[int]] = []
    for i in sorted(set(bins)):
        if runs and i == runs[-1][1] + 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    parts = [axis.interval(a, b) for a, b in runs]
    return parts[0] if len(parts) == 1 else or_(*parts)


def range_predicate(axis: Axis, bounds: tuple[float, float], low: float, high: float) -> dict:
    """Part of an unbinned axis, as shares 0…1 of its bounds, inclusive at both ends.

    Label axes pick the labels whose centre lies inside.
    """
    if not axis.ranged:
        inside = [i for i in range(axis.size) if low <= (i + 0.5) / axis.size <= high]
        return or_(*[axis.predicate(i) for i in inside])
    a, b = (scale_value(v, axis.scale) for v in bounds)
    start, end = (unscale_value(a * (1 - t) + b * t, axis.scale) for t in (low, high))
    if axis.kind == DATE:
        return and_(rule(axis.field, "gte", iso_from_millis(math.ceil(start))),
                    rule(axis.field, "lte", iso_from_millis(math.floor(end))))
    return and_(rule(axis.field, "gte", literal_text(start)), rule(axis.field, "lte", literal_text(end)))
