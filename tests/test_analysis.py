"""Saved analyses, bundles, written tables and the generated observations."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from pointloom.operators.charts import ChartSpec, selected_count
from pointloom.operators.expressions import and_, bbox, or_, row, rule
from pointloom.operators.integrity import dataset_bounds
from pointloom.operators.picking import pick_rectangle
from pointloom.plans.run import resolve_bounds, run_analysis, run_tables, timeline_extents
from pointloom.plans.spec import AnalysisSpec, SavedChart, SeriesMap, SourceAnalysis, SpecError, migrate_spec, schema_compatible, validate_spec
from pointloom.sinks.bundle import export_bundle, import_bundle
from pointloom.sinks.export import write_points
from pointloom.sources.bounds import LoadBounds
from pointloom.sources.config import SourceConfig
from pointloom.sources.generate import generate_points, unit_hash
from pointloom.table import Field


def csv_source(id, path, **more):
    return SourceConfig(**{"id": id, "name": id, "type": "csv", "path": path, "longitude_field": "lon", "latitude_field": "lat", "time_field": "t", **more})


def spec(path_a="a.csv", path_b="b.csv"):
    return AnalysisSpec(
        sources=(csv_source("a", path_a), csv_source("b", path_b), csv_source("off", "missing.csv", enabled=False)),
        analyses=(SourceAnalysis("a", (Field("v", "number"),), rule("v", "gte", 1), (SavedChart(ChartSpec("v", "bar", "v", bins=2)),
                                 SavedChart(ChartSpec("both", "bar", "v", bins=2), (SeriesMap("b", "w"),)))),
                  SourceAnalysis("b", (Field("w", "string"),), rule("w", "eq", "x"))),
        coloring={"a": {"field": "v", "scheme": "ocean"}}, bounds=LoadBounds(box=(-10, -10, 10, 10)), box=bbox(-10, -10, 5, 10) and {"west": -10, "south": -10, "east": 5, "north": 10})


def test_a_saved_analysis_runs_end_to_end(spark, tmp_path):
    (tmp_path / "a.csv").write_text("lon,lat,t,v\n1,1,2024-01-01,0\n1,1,2024-01-02,2\n9,1,2024-01-02,4\n50,1,2024-01-02,9\n")
    (tmp_path / "b.csv").write_text("lon,lat,t,w\n2,2,2024-01-01,1\n2,2,2024-01-03,3\n")
    saved = AnalysisSpec.from_json(spec(str(tmp_path / "a.csv"), str(tmp_path / "b.csv")).to_json())
    run = run_analysis(spark, saved, str(tmp_path / "out"))
    assert set(run.tables) == {"a", "b"} and run.skipped_filters == ["b"]
    assert run.reports["a"].first().loaded == 3
    counts = {r.cell: r["count"] for r in run.charts["a", "v"].collect()}
    assert counts == {-1: 0, 0: 0, 1: 1}
    both = {(r.source_id, r.cell): r["count"] for r in run.charts["a", "both"].collect()}
    assert both[None, 0] + both[None, 1] == 3 and both["b", 0] == 1 and both["b", 1] == 1
    assert timeline_extents(run)["b"].first().end == 1704240000000
    windowed = run_tables(AnalysisSpec(window=(1704153600000, 1704153600000)), run.tables)
    assert windowed.tables["a"].df.where(windowed.selections["a"]).count() == 2


def test_unbinned_charts_colours_and_import_reports_are_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text("lon,lat,t,v,k\n1,1,2024-01-01,0,x\n1,1,2024-01-02,2,y\n9,1,2024-01-02,4,x\nbad,1,2024-01-02,9,x\n")
    (tmp_path / "b.csv").write_text("lon,lat,t,w,u\n2,2,2024-01-01,1,5\n2,2,2024-01-03,3,6\n")
    raw = ChartSpec("raw", "scatter", "v", "lat", binned=False)
    saved = AnalysisSpec(
        sources=(csv_source("a", str(tmp_path / "a.csv")), csv_source("b", str(tmp_path / "b.csv"))),
        analyses=(SourceAnalysis("a", (Field("v", "number"),), rule("v", "gte", 1),
                                 (SavedChart(raw), SavedChart(ChartSpec("two", "scatter", "v", "v", binned=False), (SeriesMap("b", "w", "u"),)))),),
        coloring={"a": {"field": "k", "overrides": {"x": "#010203"}}, "b": {"field": "w", "bins": 2}})
    run = run_analysis(spark, saved, str(tmp_path / "out"))
    assert sorted(run.charts["a", "raw"].columns) == ["row", "x", "y"] and run.charts["a", "raw"].count() == 2
    assert {r[0]: r[1] for r in run.charts["a", "two"].groupBy("source_id").count().collect()} == {"a": 2, "b": 2}
    assert sorted(r.color for r in run.colors["a"].collect())[:2] == ["#010203", "#010203"] and run.colors["b"].select("color").distinct().count() == 2
    assert run.imports["a"].totals["rejected"] == 1 and run.imports["b"].totals["imported"] == 2
    assert not run.reports["a"].first().truncated
    alone, = run.plots["a", "raw"].collect()
    assert (alone.source_id, alone.selected, alone.plotted, alone.missing) == ("a", 2, 2, 0) and (alone.x0, alone.x1) == (0.5, 1.0)
    assert {r.source_id: (r.selected, r.plotted, r.missing) for r in run.plots["a", "two"].collect()} == {"a": (2, 2, 0), "b": (2, 2, 0)}


def test_rows_without_a_place_and_without_an_ellipse_are_counted(spark, tmp_path):
    (tmp_path / "a.csv").write_text("lon,lat,t,v,w,major,minor,turn\n1,1,2024-01-01,1,5,10,2,90\n1,1,2024-01-01,2,,10,0,90\n1,1,2024-01-01,3,7,3,1,\n"
                                    "1,1,2024-01-01,-1,8,2,1,0\n1,1,2024-01-01,9,9,2e9,1,0\n")
    axes = {"major_field": "major", "minor_field": "minor", "orientation_field": "turn"}
    saved = AnalysisSpec(
        sources=(csv_source("a", str(tmp_path / "a.csv"), minor_unit="nm", **axes), csv_source("b", str(tmp_path / "a.csv"), **{**axes, "minor_field": "nowhere"}),
                 csv_source("c", str(tmp_path / "a.csv"))),
        analyses=(SourceAnalysis("a", (), rule("v", "lt", 9), (SavedChart(ChartSpec("raw", "scatter", "v", "w", binned=False, x_scale="log10")),)),))
    run = run_analysis(spark, AnalysisSpec.from_json(saved.to_json()), str(tmp_path / "out"))
    assert run.reports["a"].first().invalid_ellipses == 3 and run.reports["b"].first().invalid_ellipses == 5
    assert "invalid_ellipses" not in run.reports["c"].columns
    plot, = run.plots["a", "raw"].collect()
    assert (plot.selected, plot.plotted, plot.missing) == (4, 2, 2)
    assert [round(v, 6) for v in (plot.x0, plot.y0, plot.x1, plot.y1)] == [0.0, 0.0, 0.5, 0.5]
    empty = run_tables(AnalysisSpec(analyses=(SourceAnalysis("a", (), rule("v", "gt", 99), (SavedChart(ChartSpec("raw", "scatter", "v", "w", binned=False)),)),)), {"a": run.tables["a"]})
    assert empty.plots["a", "raw"].first().selected == 0 and empty.plots["a", "raw"].first().x0 is None


def test_ellipse_settings_come_whole():
    for wrong in ({"major_field": "a"}, {"major_field": "a", "minor_field": "b", "orientation_field": 5}, {"minor_unit": "km"}):
        with pytest.raises(ValueError):
            csv_source("a", "p", **wrong).check()
    old = csv_source("a", "p").to_dict()
    del old["major_field"]
    assert SourceConfig.from_dict(old).check().ellipses() is None


def test_round_trip_and_defaults():
    s = spec()
    assert AnalysisSpec.from_json(s.to_json()) == s or json.loads(AnalysisSpec.from_json(s.to_json()).to_json()) == json.loads(s.to_json())
    old = migrate_spec({"sources": [{"id": "a", "name": "a", "type": "csv", "path": "p", "longitude_field": "x", "latitude_field": "y"}],
                        "analyses": [{"source": "a", "charts": [{"id": "c", "type": "bar", "x": "v"}]}]})
    assert AnalysisSpec.from_dict(validate_spec(old)).analyses[0].charts[0].spec.bins == 24
    assert resolve_bounds(AnalysisSpec(choice="6"), datetime(2024, 1, 1, 6, tzinfo=timezone.utc)).time == ("2024-01-01T00:00:00.000Z", "2024-01-01T06:00:00.000Z")
    assert resolve_bounds(AnalysisSpec(choice="all", bounds=LoadBounds(("2024-01-01", "2024-01-02")))).time is None


def test_single_rows_are_never_saved():
    s = AnalysisSpec(sources=(csv_source("a", "p"),), analyses=(SourceAnalysis("a", (), and_(or_(row(3)))),))
    with pytest.raises(SpecError, match="Individual-observation"):
        s.to_json()


def broken():
    good = spec().to_dict
    def change(path, value):
        d = json.loads(json.dumps(good()))
        at = d
        for k in path[:-1]:
            at = at[k]
        at[path[-1]] = value
        return d
    yield "version", change(["version"], 2)
    yield "extra key", change(["extra"], 1)
    yield "extra source key", change(["sources", 0, "secret"], "x")
    yield "double id", change(["sources", 1, "id"], "a")
    yield "nine sources", change(["sources"], [dict(good()["sources"][0], id=str(i)) for i in range(9)])
    yield "choice", change(["query", "choice"], "7")
    yield "window", change(["window"], [2, 1])
    yield "box", change(["box"], {"west": 0, "south": 5, "east": 1, "north": 4})
    yield "operator", change(["analyses", 0, "expression"], {"op": "row", "index": 1})
    yield "literal", change(["analyses", 0, "expression"], {"op": "eq", "field": "v", "value": 5})
    yield "long set", change(["analyses", 0, "expression"], {"op": "in", "field": "v", "values": ["x"] * 10001})
    yield "unknown source", change(["analyses", 0, "source"], "zz")
    yield "chart type", change(["analyses", 0, "charts", 0, "type"], "donut")
    yield "aggregate", change(["analyses", 0, "charts", 0, "aggregate"], "median")
    yield "series twice", change(["analyses", 0, "charts", 1, "series"], [{"source": "a", "x": "v", "y": None}])
    yield "hidden stranger", change(["analyses", 0, "charts", 1, "hidden"], ["off"])
    yield "thirteen charts", change(["analyses", 0, "charts"], [good()["analyses"][0]["charts"][0]] * 13)
    yield "scheme", change(["coloring", "a", "scheme"], "rainbow")
    yield "colour", change(["coloring", "a", "overrides"], {"x": "red"})
    yield "kind", change(["analyses", 0, "fields"], [{"name": "v", "kind": "decimal"}])
    yield "rule", change(["sources", 0, "load_rules"], [{"field": "v", "kind": "number", "op": "contains", "value": "1"}])
    yield "size", change(["sources", 0, "name"], "x" * 1_100_000)


@pytest.mark.parametrize("name,saved", list(broken()), ids=lambda v: v if isinstance(v, str) else "")
def test_bad_analyses_are_refused(name, saved):
    with pytest.raises(SpecError):
        validate_spec(saved)


def test_filters_need_their_attributes(table):
    t = table("v double, s string", [(1.0, "x")])
    assert schema_compatible([Field("v", "number")], t) and not schema_compatible([Field("v", "string")], t) and not schema_compatible([Field("z", "number")], t)


def test_bundles_are_checked_on_the_way_in(spark, table, tmp_path):
    a, b = table("v double, `dotted.name` string", [(1.0, "x"), (None, None)], name="A"), table("t string", [], name="B")
    path = str(tmp_path / "bundle")
    export_bundle(spark, path, {"a": a, "b": b}, AnalysisSpec(sources=(csv_source("a", "p"),)))
    tables, saved = import_bundle(spark, path)
    assert tables["a"].df.count() == 2 and tables["a"].fields == a.fields and tables["b"].df.count() == 0 and saved.sources[0].id == "a"
    (tmp_path / "bundle" / "extra").mkdir()
    with pytest.raises(SpecError, match="unexpected"):
        import_bundle(spark, path)
    with pytest.raises(SpecError, match="manifest"):
        import_bundle(spark, str(tmp_path / "nothing"))
    with pytest.raises(SpecError):
        export_bundle(spark, str(tmp_path / "big"), {str(i): a for i in range(9)})


def test_written_tables_skip_files(spark, tmp_path):
    t = write_points(generate_points(spark, 20000, "world"), str(tmp_path / "w"), 8)
    box = (0.2, 0.3, 0.22, 0.32)
    assert {r.row for r in pick_rectangle(t, *box, cell_column="grid_cell").collect()} == {r.row for r in pick_rectangle(t, *box).collect()} != set()


def test_generated_observations_match_the_published_counts(spark):
    """Three million rows on the large area; the smaller counts on its first half."""
    t = generate_points(spark, 3_000_000)
    nested = and_(or_(rule("category", "eq", "sensor"), rule("category", "eq", "vehicle")), rule("value", "gte", 50), rule("timestamp", "gte", "2025-01-01"))
    assert selected_count(t, nested).first()[0] == 500_040
    assert selected_count(t, bbox(-5, 52, 0, 56)).first()[0] == 667_181
    half = t.with_df(t.df.where(F.col("row_id") < 1_500_000))
    assert selected_count(half, and_(rule("category", "eq", "sensor"), rule("value", "gte", 50))).first()[0] == 187_366
    assert selected_count(half, and_(rule("category", "eq", "vehicle"), rule("quality", "gte", 80))).first()[0] == 76_840
    assert tuple(dataset_bounds(t).first()) == (-7.999979624990374, 50.00000135367736, 1.9999950523488224, 58.99999902979471)
    assert 0 <= spark.range(1000).agg(F.min(unit_hash(F.col("id")))).first()[0] < 0.01
    with pytest.raises(ValueError):
        generate_points(spark, -1)
