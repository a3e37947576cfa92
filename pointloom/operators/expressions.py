"""Filters: a nested AND/OR tree of predicates compiled into one boolean column.

Trees are plain JSON-like dicts, so they can be saved with an analysis. Literals
are parsed once on the driver and compared with the bare column, which keeps the
predicate visible to the Parquet reader.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from ..functions.values import NUMBER_PATTERN, iso_from_millis, literal_text, parse_utc, parse_utc_millis
from ..table import BOOLEAN, DATE, NUMBER, STRING, Field, PointTable, quote

# The limits of one filter and of one list of load rules.
MAX_NODES, MAX_DEPTH, MAX_LOAD_RULES, MAX_LITERAL = 128, 8, 100, 8192

ORDERED = ("gt", "gte", "lt", "lte")
MISSING_TESTS = ("null", "notnull")
SETS = ("in", "notin")
OPERATORS = ("eq", "ne", *ORDERED, "contains", *MISSING_TESTS, *SETS)

ALL_ROWS = {"op": "and", "children": []}


# --- builders -------------------------------------------------------------

def and_(*children: dict) -> dict:
    return {"op": "and", "children": list(children)}


def or_(*children: dict) -> dict:
    return {"op": "or", "children": list(children)}


def rule(field: str, op: str, value: object = None, values: Sequence[str] | None = None) -> dict:
    out: dict = {"field": field, "op": op}
    if value is not None:
        out["value"] = value if isinstance(value, str) else literal_of(value)
    if values is not None:
        out["values"] = list(values)
    return out


def bbox(west: float, south: float, east: float, north: float) -> dict:
    return {"op": "bbox", "west": west, "south": south, "east": east, "north": north}


def row(index: int) -> dict:
    return {"op": "row", "index": index}


def clear_filters() -> dict:
    """The filter that keeps every row."""
    return and_()


def literal_of(value: object) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return literal_text(value)
    return str(value)


# --- literals -------------------------------------------------------------

def number_literal(text: str) -> float:
    if not re.match(NUMBER_PATTERN, text.strip()) or not math.isfinite(float(text)):
        raise ValueError(f"Invalid number: {text}")
    return float(text)


def date_literal(text: str) -> int:
    millis = parse_utc_millis(text)
    if millis is None:
        raise ValueError(f"Invalid date: {text}")
    return millis


def boolean_literal(text: str) -> bool:
    if text in ("true", "1"):
        return True
    if text in ("false", "0"):
        return False
    raise ValueError(f"Invalid boolean {text}")


def timestamp(millis: int) -> Column:
    return F.expr(f"timestamp_millis({int(millis)}L)")


COMPARE = {"eq": operator.eq, "ne": operator.ne, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


def _compare_time(c: Column, op: str, millis: int) -> Column:
    """Compare whole milliseconds without wrapping the column.

    A stored value belongs to the millisecond it falls in, so each test becomes a
    test against the start of that millisecond or of the next one.
    """
    c = c.cast("timestamp")
    if op in ("gte", "lt"):
        return COMPARE[op](c, timestamp(millis))
    if op in ("gt", "lte"):
        return COMPARE["gte" if op == "gt" else "lt"](c, timestamp(millis + 1))
    within = (c >= timestamp(millis)) & (c < timestamp(millis + 1))
    return within if op == "eq" else ~within


# --- predicates -----------------------------------------------------------

def field_predicate(c: Column, field: Field, node: dict) -> Column:
    """One test on one attribute. Missing values never match an ordinary test."""
    op = node.get("op")
    if op not in OPERATORS:
        raise ValueError("Invalid filter operator")
    if op == "null":
        return c.isNull()
    if op == "notnull":
        return c.isNotNull()
    if op in SETS:
        values = node.get("values")
        if field.kind != STRING:
            raise ValueError("in and notin work on text only")
        if not isinstance(values, (list, tuple)):
            raise ValueError("in and notin need a list of values")
        if not values:
            return F.lit(False) if op == "in" else c.isNotNull()
        return c.isin(*values) if op == "in" else ~c.isin(*values)
    value = node.get("value")
    if value is None:
        raise ValueError("Missing filter value")
    value = str(value)
    if op == "contains":
        if field.kind != STRING:
            raise ValueError("contains works on text only")
        return F.contains(c, F.lit(value))
    if field.kind == STRING:
        return COMPARE[op](c, F.lit(value))
    if field.kind == NUMBER:
        return COMPARE[op](c, F.lit(number_literal(value)))
    if field.kind == BOOLEAN:
        return COMPARE[op](c, F.lit(boolean_literal(value)))
    return _compare_time(c, op, date_literal(value))


def box_predicate(lon: Column, lat: Column, box: dict) -> Column:
    """Inclusive box; west beyond east means the box crosses the antimeridian."""
    try:
        west, east, south, north = (float(box[k]) for k in ("west", "east", "south", "north"))
    except (KeyError, TypeError, ValueError) as error:
        raise ValueError("Invalid geographic bounds") from error
    if not all(map(math.isfinite, (west, east, south, north))) or max(abs(west), abs(east)) > 180 \
            or max(abs(south), abs(north)) > 90 or south > north:
        raise ValueError("Invalid geographic bounds")
    across = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & across


def compile_expression(table: PointTable, expression: dict) -> Column:
    """Compile a filter tree; every mistake in it is raised here, before any job."""
    nodes = 0

    def visit(node: dict, depth: int) -> Column:
        nonlocal nodes
        nodes += 1
        if nodes > MAX_NODES or depth > MAX_DEPTH:
            raise ValueError(f"A filter has at most {MAX_NODES} nodes in {MAX_DEPTH} levels")
        if not isinstance(node, dict):
            raise ValueError("Invalid filter group")
        op = node.get("op")
        if "children" in node:
            children = node["children"]
            if op not in ("and", "or") or not isinstance(children, (list, tuple)):
                raise ValueError("Invalid filter group")
            parts = [visit(child, depth + 1) for child in children]
            if not parts:
                return F.lit(op == "and")
            return reduce(Column.__and__ if op == "and" else Column.__or__, parts)
        if op == "row":
            index = node.get("index")
            if isinstance(index, bool) or not isinstance(index, int) or index < 0:
                raise ValueError("Invalid point index")
            return table.col(table.row) == F.lit(index)
        if op == "bbox":
            return box_predicate(table.col(table.lon), table.col(table.lat), node)
        field = table.field(node.get("field"))
        return field_predicate(table.col(field.name), field, node)

    return visit(expression, 0)


def as_flag(predicate: Column) -> Column:
    """A predicate that is shown as a value: missing counts as false."""
    return F.coalesce(predicate, F.lit(False))


# --- windows and shared restrictions --------------------------------------

def timeline_window(table: PointTable, field: str | None, start: int, end: int) -> Column:
    """Inclusive window in epoch milliseconds on a date or parsable text attribute.

    Rows without a time drop out; a table without a time attribute is unchanged.
    """
    if start > end:
        raise ValueError("Invalid timeline window")
    if not field:
        return F.lit(True)
    kind = table.field(field).kind
    if kind not in (DATE, STRING):
        raise ValueError("A timeline needs a time attribute")
    c = table.col(field).cast("timestamp") if kind == DATE else parse_utc(table.col(field))
    return (c >= timestamp(start)) & (c < timestamp(end + 1))


def shared_box(predicate: Column, table: PointTable, box: dict | None) -> Column:
    """Intersect a filter with the box that all tables share."""
    if box is None:
        return predicate
    return predicate & box_predicate(table.col(table.lon), table.col(table.lat), box)


def applied(table: PointTable, expression: dict | None = None, *, window: tuple[int, int] | None = None,
            time_field: str | None = None, box: dict | None = None) -> Column:
    """The whole selection of one table: its filter, the shared box and the window."""
    predicate = compile_expression(table, expression or ALL_ROWS)
    predicate = shared_box(predicate, table, box)
    if window is not None:
        predicate = predicate & timeline_window(table, time_field or table.time_field or None, *window)
    return predicate


def applied_scope(table: PointTable, scope: str, predicate: Column | None) -> PointTable:
    """Rows an operation works on: everything loaded, or the current selection."""
    if scope not in ("loaded", "applied"):
        raise ValueError(f"Unknown scope {scope!r}")
    if scope == "loaded" or predicate is None:
        return table
    return table.with_df(table.df.where(predicate))


# --- rules applied while loading ------------------------------------------

def load_rule_operators(kind: str) -> tuple[str, ...]:
    """Tests allowed at load time for one kind."""
    ordered = ORDERED if kind in (NUMBER, DATE) else ()
    text = ("contains",) if kind == STRING else ()
    return ("eq", "ne", *ordered, *text, *MISSING_TESTS)


def load_rule_literal(r: dict) -> str:
    """The literal of one load rule in its canonical text form."""
    value = r.get("value", "")
    kind = r["kind"]
    if kind == STRING:
        return value
    if kind == NUMBER:
        try:
            return literal_text(number_literal(value))
        except ValueError as error:
            raise ValueError(f"{r['field']}: not a finite number") from error
    if kind == BOOLEAN:
        if value not in ("true", "false"):
            raise ValueError(f"{r['field']}: neither true nor false")
        return value
    millis = parse_utc_millis(value)
    if millis is None:
        raise ValueError(f"{r['field']}: not a time")
    return iso_from_millis(millis)


def validate_load_rules(rules: Iterable[dict], fields: Sequence[Field] | None = None) -> list[dict]:
    """Check a list of load rules, against a schema when one is given."""
    rules = list(rules)
    if len(rules) > MAX_LOAD_RULES:
        raise ValueError(f"More than {MAX_LOAD_RULES} load rules")
    for r in rules:
        name, kind, op, value = r.get("field"), r.get("kind"), r.get("op"), r.get("value")
        shaped = (set(r) <= {"field", "kind", "op", "value"} and isinstance(name, str) and name.strip()
                  and len(name) <= MAX_LITERAL and kind in (NUMBER, STRING, DATE, BOOLEAN)
                  and op in load_rule_operators(kind)
                  and (value is None or (isinstance(value, str) and len(value) <= MAX_LITERAL)))
        if not shaped:
            raise ValueError("Invalid load rule.")
        if fields is not None and Field(name, kind) not in fields:
            raise ValueError(f"A load rule is about {name}, which is not there or of another kind")
        if op not in MISSING_TESTS:
            if value is None:
                raise ValueError(f"The load rule about {name} has no value")
            load_rule_literal(r)
    return rules


def load_rules(rules: Iterable[dict], fields: Sequence[Field], columns: dict[str, Column] | None = None) -> Column:
    """All load rules as one predicate. ``columns`` overrides where values come from."""
    checked = validate_load_rules(rules, fields)
    parts = []
    for r in checked:
        c = (columns or {}).get(r["field"], F.col(quote(r["field"])))
        node = dict(r) if r["op"] in MISSING_TESTS else {**r, "value": load_rule_literal(r)}
        parts.append(field_predicate(c, Field(r["field"], r["kind"]), node))
    return reduce(Column.__and__, parts, F.lit(True))
