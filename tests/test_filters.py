"""Filters: a naive evaluator against the compiled one, limits and mistakes."""

import random

import pytest

from pointloom.operators.expressions import (and_, applied, bbox, compile_expression, date_literal, load_rules, or_, row, rule, validate_load_rules)
from pointloom.functions.values import parse_utc_millis

SCHEMA = "n double, text string, day string, flag boolean"
ROWS = [(None, None, None, None), (1.0, "north", "2024-01-01", True), (2.0, "south", "2024-01-02T10:00", False), (2.5, "North east", "2024-01-03", True),
        (-1.0, "", "2024-01-02", None), (0.0, "100%", None, False)]


def ids(t, expression):
    return sorted(r[0] for r in t.df.where(compile_expression(t, expression)).select("row_id").collect())


@pytest.fixture
def small(table):
    from pyspark.sql import functions as F
    from pointloom.functions.values import parse_utc
    from pointloom.table import describe
    t = table(SCHEMA, ROWS, lon=[-179.0, 179.0, 0.0, 10.0, -10.0, 180.0], lat=[0.0, 0.0, 10.0, 20.0, -10.0, 90.0])
    df = t.df.withColumn("day", parse_utc(F.col("day")))
    return describe(df, row="row_id", id="point_id", lon="lon", lat="lat")


def naive(node, i, data):
    if "children" in node:
        results = [naive(c, i, data) for c in node["children"]]
        return all(results) if node["op"] == "and" else any(results)
    value = data[i][{"n": 0, "text": 1, "day": 2, "flag": 3}[node["field"]]]
    op, field = node["op"], node["field"]
    if op in ("null", "notnull"):
        return (value is None) == (op == "null")
    if value is None:
        return False
    if op in ("in", "notin"):
        return (value in node["values"]) == (op == "in")
    want = {"n": float, "text": str, "day": parse_utc_millis, "flag": lambda v: v in ("true", "1")}[field](node["value"])
    value = parse_utc_millis(value) if field == "day" else value
    return {"eq": value == want, "ne": value != want, "gt": value > want, "gte": value >= want, "lt": value < want, "lte": value <= want,
            "contains": op == "contains" and want in value}[op]


LEAVES = ([rule("n", op, v) for op in ("eq", "ne", "gt", "gte", "lt", "lte") for v in (0, 2, 2.5)]
          + [rule("text", op, v) for op in ("eq", "ne", "gt", "gte", "lt", "lte", "contains") for v in ("north", "North", "", "%")]
          + [rule("day", op, v) for op in ("eq", "ne", "gt", "gte", "lt", "lte") for v in ("2024-01-02", "2024-01-02T12:00+02:00")]
          + [rule("flag", op, v) for op in ("eq", "ne") for v in ("true", "0")]
          + [rule(f, op) for f in ("n", "text", "day", "flag") for op in ("null", "notnull")]
          + [rule("text", op, values=v) for op in ("in", "notin") for v in ([], ["north", ""], ["x"])])


def test_every_operator_against_a_naive_evaluator(small):
    for leaf in LEAVES:
        assert ids(small, leaf) == [i for i in range(len(ROWS)) if naive(leaf, i, ROWS)], leaf


def test_random_trees_against_a_naive_evaluator(small):
    rng = random.Random(7)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(LEAVES)
        return {"op": rng.choice(["and", "or"]), "children": [tree(depth - 1) for _ in range(rng.randint(0, 3))]}

    for _ in range(25):
        t = tree(4)
        assert ids(small, t) == [i for i in range(len(ROWS)) if naive(t, i, ROWS)], t


def test_empty_groups(small):
    assert ids(small, and_()) == list(range(6)) and ids(small, or_()) == []


def test_boxes_are_inclusive_and_cross_the_antimeridian(small):
    assert ids(small, bbox(-10, -10, 10, 20)) == [2, 3, 4]
    assert ids(small, bbox(170, -90, -170, 90)) == [0, 1, 5]
    assert ids(small, row(3)) == [3]


@pytest.mark.parametrize("bad", [bbox(-181, 0, 0, 1), bbox(0, 5, 1, 4), bbox(float("nan"), 0, 0, 1), row(-1), {"op": "row", "index": 1.5}, rule("missing", "eq", "1"),
                                 rule("n", "contains", "1"), rule("n", "eq"), rule("n", "eq", "abc"), rule("n", "eq", "Infinity"), rule("day", "eq", "yesterday"),
                                 rule("flag", "eq", "yes"), rule("n", "in", values=["1"]), rule("text", "in"), {"op": "xor", "children": []}, rule("n", "like", "1")])
def test_mistakes_fail_before_a_job(small, bad):
    with pytest.raises(ValueError):
        compile_expression(small, bad)


def test_limits(small):
    wide = and_(*[rule("n", "eq", 1)] * 127)
    compile_expression(small, wide)
    with pytest.raises(ValueError):
        compile_expression(small, and_(*[rule("n", "eq", 1)] * 128))
    deep = rule("n", "eq", 1)
    for _ in range(8):
        deep = and_(deep)
    compile_expression(small, deep)
    with pytest.raises(ValueError):
        compile_expression(small, and_(deep))


def test_window_and_shared_box(small):
    day = date_literal("2024-01-02")
    got = small.df.where(applied(small, window=(day, day + 86400000), time_field="day")).select("row_id").collect()
    assert sorted(r[0] for r in got) == [2, 3, 4]
    got = small.df.where(applied(small, rule("flag", "eq", True), box=bbox(-180, -90, 180, 10))).select("row_id").collect()
    assert sorted(r[0] for r in got) == [1]
    assert small.df.where(applied(small, window=(0, 1), time_field=None)).count() == 6
    with pytest.raises(ValueError):
        applied(small, window=(2, 1), time_field="day")
    with pytest.raises(ValueError):
        applied(small, window=(1, 2), time_field="n")


def test_load_rules_are_strict(small):
    rules = [{"field": "n", "kind": "number", "op": "gte", "value": " 1e0 "}, {"field": "text", "kind": "string", "op": "contains", "value": "orth"}]
    assert sorted(r[0] for r in small.df.where(load_rules(rules, small.fields)).select("row_id").collect()) == [1, 3]
    for bad in ({"field": "n", "kind": "string", "op": "eq", "value": "1"}, {"field": "n", "kind": "number", "op": "contains", "value": "1"},
                {"field": "flag", "kind": "boolean", "op": "eq", "value": "1"}, {"field": "text", "kind": "string", "op": "gt", "value": "a"},
                {"field": "n", "kind": "number", "op": "eq"}, {"field": "n", "kind": "number", "op": "eq", "value": "1", "x": 1}, {"field": " ", "kind": "string", "op": "null"}):
        with pytest.raises(ValueError):
            load_rules([bad], small.fields)
    with pytest.raises(ValueError):
        validate_load_rules([rules[0]] * 101)


def test_stored_filters_reach_the_scan(spark, small, tmp_path):
    """Nested value, time and box tests show up as pushed filters of a Parquet scan."""
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    small.df.write.parquet(path)
    stored = small.with_df(spark.read.parquet(path))
    test = and_(or_(rule("text", "eq", "north"), rule("n", "gt", 1)), rule("day", "gte", "2024-01-02"), bbox(-10, -10, 10, 20))
    plan = stored.df.where(compile_expression(stored, test)).select("row_id")._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1]
    for part in ("GreaterThanOrEqual(day", "GreaterThanOrEqual(lat", "LessThanOrEqual(lon", "Or("):
        assert part in pushed
    assert "flag" not in plan.split("ReadSchema")[1]


