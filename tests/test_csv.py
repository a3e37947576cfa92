"""CSV loads: types, reasons, line numbers, bounds, and records that span lines."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from pointloom.operators.integrity import LoadError
from pointloom.sources import csv as csv_source
from pointloom.sources.bounds import LoadBounds
from pointloom.sources.config import SourceConfig
from pointloom.sources.csv import csv_headers, describe_csv, load_csv, read_records
from pointloom.sources.roles import match_point_columns, resolve_role_predictions


@pytest.fixture
def write(tmp_path):
    def put(text, name="data.csv"):
        path = tmp_path / name
        path.write_bytes(text if isinstance(text, bytes) else text.encode("utf-8"))
        return str(path)
    return put


def config(path, **more):
    return SourceConfig(**{"id": "c", "name": "c", "type": "csv", "path": path, "longitude_field": "lon", "latitude_field": "lat", **more})


def rows(load, *columns):
    return [tuple(r) for r in load.table.df.orderBy(load.table.row).select(*columns).collect()]


def issues(load):
    return {r.reason: (r["count"], list(r.lines)) for r in load.issues.collect()}


def test_whole_file_decides_the_types(spark, write):
    load = load_csv(spark, config(write("lon,lat,when,value,mixed,active\n1,2,2024-01-01T10:00,1.5,1,TRUE\n3,4,,,x,\n5,6,2024-01-02,-2e1,2,false\n"), time_field="when"))
    assert [(f.name, f.kind) for f in load.table.fields] == [("lon", "number"), ("lat", "number"), ("when", "date"), ("value", "number"), ("mixed", "string"), ("active", "boolean")]
    assert rows(load, "value", "mixed", "active") == [(1.5, "1", True), (None, "x", None), (-20.0, "2", False)]
    assert [r[0] for r in rows(load, F.date_format("when", "yyyy-MM-dd HH:mm"))] == ["2024-01-01 10:00", None, "2024-01-02 00:00"]


REJECTS = ('lon,lat,t,note\r\n'            # 1
           '1,2,2024-01-01,"two\r\nlines"\r\n'  # 2-3
           '\r\n'                           # 4
           '1,2,2024-01-01\r\n'             # 5 short
           '"1"x,2,2024-01-01,bad\r\n'      # 6 quoting
           ',,,\r\n'                        # 7 delimiters only
           '1,2,not a time,x\r\n'           # 8
           '200,2,2024-01-01,x\r\n'         # 9
           '3,4,2024-01-02,"say ""hi"", ok"\r\n'  # 10
           'abc,2,2024-01-01,x\r\n')        # 11


def test_every_row_is_accounted_for(spark, write):
    load = load_csv(spark, config(write(REJECTS), time_field="t"))
    assert load.totals == {"total": 8, "imported": 2, "rejected": 6, "filtered": 0}
    assert rows(load, "point_id", "note") == [("csv.2", "two\r\nlines"), ("csv.10", 'say "hi", ok')]
    assert issues(load) == {"Expected 4 columns; found 3": (1, [5]), "Malformed CSV quoting": (1, [6]), 'Missing longitude in "lon"': (1, [7]),
                            'Invalid ISO 8601 time in "t"': (1, [8]), "Coordinate is invalid: longitude 200, latitude 2. Expected finite WGS84 degrees.": (1, [9]),
                            "Longitude and latitude must be decimal numbers": (1, [11])}
    assert "2 of 8 data rows imported; 6 rejected" in load.summary()


def test_text_that_cannot_be_read_is_refused(spark, write):
    with pytest.raises(LoadError, match="carriage return"):
        load_csv(spark, config(write("lon,lat\r1,2\r3,4\r")))
    with pytest.raises(LoadError, match="UTF-8"):
        load_csv(spark, config(write(b"lon,lat,s\n1,2,ok\n3,4,\xff\xfe\n")))
    assert rows(load_csv(spark, config(write('lon,lat,s\r\n1,2,"a\rb"\r\n'))), "s") == [("a\rb",)]


def test_only_five_example_lines(spark, write):
    load = load_csv(spark, config(write("lon,lat\n1,2\n" + "x,1\n" * 9)))
    assert issues(load) == {"Longitude and latitude must be decimal numbers": (9, [3, 4, 5, 6, 7])}


def test_bounds_and_errors_are_told_apart(spark, write):
    text = "lon,lat,t,empty\n1,2,2024-01-01,\n1,2,,\n1,2,2025-01-01,\n50,2,2024-01-01T12:00,\n"
    load = load_csv(spark, config(write(text), time_field="t"), LoadBounds(("2024-01-01", "2024-02-01"), (0, 0, 10, 10)))
    assert load.totals == {"total": 4, "imported": 1, "rejected": 1, "filtered": 2}
    assert list(issues(load)) == ['Missing time in "t" required by the selected time bounds']
    with pytest.raises(LoadError):
        load_csv(spark, config(write(text)), LoadBounds(("2024-01-01", "2024-02-01")))
    for bad in (LoadBounds(("2024-02-01", "2024-01-01")), LoadBounds(box=(10, 0, 0, 10))):
        with pytest.raises(ValueError):
            load_csv(spark, config(write(text), time_field="t"), bad)


def test_overrides_keep_leading_zeros_and_reject_misfits(spark, write):
    text = "lon,lat,code,value,flag,when\n1,2,001,5,true,2024-01-01\n1,2,002,x,maybe,2024-01-01\n1,2,003,y,1,x\n1,2,004,7,yes,2024-01-01\n"
    load = load_csv(spark, config(write(text), field_types={"code": "string", "value": "number", "flag": "boolean", "when": "date"}))
    assert rows(load, "code") == [("001",)]
    assert {k: v[0] for k, v in issues(load).items()} == {'Invalid number in "value"': 2, 'Expected true or false in "flag"': 1}
    for bad in ({"nope": "string"}, {"code": "text"}):
        with pytest.raises(ValueError):
            load_csv(spark, config(write(text), field_types=bad))
    with pytest.raises(ValueError):
        config(write(text), time_field="when", field_types={"when": "string"}).check()


def test_geometry_columns(spark, write):
    wkt = load_csv(spark, config(write('geom;n\nPOINT (-1 54);1\n" point(2   3) ";2\nPOINT (1 2 3);3\nLINE (1 2);4\n'), delimiter=";", geometry_mode="wkt", geometry_field="geom"))
    assert rows(wkt, wkt.table.lon, wkt.table.lat) == [(-1.0, 54.0), (2.0, 3.0)] and wkt.totals["rejected"] == 2
    cells = ['{"type":"Point","coordinates":[-1.5,54,7]}', '{"type":"Point","coordinates":["1",2]}', '{"type":"LineString","coordinates":[]}', "{oops", "null"]
    quoted = "\n".join('"' + c.replace('"', '""') + '"' for c in cells)
    geo = load_csv(spark, config(write("geom\n" + quoted + "\n"), geometry_mode="geojson", geometry_field="geom"))
    assert rows(geo, geo.table.lon, geo.table.lat) == [(-1.5, 54.0)]
    assert {k: v[0] for k, v in issues(geo).items()} == {'Expected a GeoJSON Point geometry in "geom"': 3, 'Invalid GeoJSON JSON in "geom"': 1}


def test_load_rules_filter_rows(spark, write):
    text = "lon,lat,value,category,active,code\n1,2,5,abc,true,001\n1,2,50,abc,true,002\n1,2,60,xyz,true,003\n1,2,,abc,true,004\n"
    rules = [{"field": "value", "kind": "number", "op": "gte", "value": "10"}, {"field": "category", "kind": "string", "op": "contains", "value": "b"}]
    load = load_csv(spark, config(write(text), load_rules=rules))
    assert rows(load, "value") == [(50.0,)] and load.totals == {"total": 4, "imported": 1, "rejected": 0, "filtered": 3}
    with pytest.raises(ValueError):
        load_csv(spark, config(write(text), load_rules=[{"field": "value", "kind": "string", "op": "eq", "value": "x"}]))


def test_mistakes_fail_the_load(spark, write):
    for text in ("", "\n \n", "lon,,lat\n1,2,3\n", "lon,lon\n1,2\n", '"lon"x,lat\n1,2\n'):
        with pytest.raises(LoadError):
            load_csv(spark, config(write(text)))
    with pytest.raises(LoadError, match="starting on CSV line 3"):
        load_csv(spark, config(write('lon,lat,n\n1,2,x\n1,2,"open\n3,4,y\n')))
    with pytest.raises(LoadError, match="Every one of the 2"):
        load_csv(spark, config(write("lon,lat\nx,y\n,\n")))
    with pytest.raises(LoadError, match="longitude column lon is not in the header"):
        load_csv(spark, config(write("x,lat\n1,2\n")))
    for bad in (dict(delimiter="|"), dict(geometry_mode="polygon"), dict(longitude_field=""), dict(path="")):
        with pytest.raises(ValueError):
            config(write("lon,lat\n1,2\n")).__class__(**{**config("p").to_dict(), **bad}).check()


def test_lone_carriage_returns_are_refused_beside_quotes(spark, write):
    for text in ('"lon",lat\r1,2\r3,4\r', 'lon,lat,n\n1,2,x\r3,4,"y"\r5,6,z\n', 'lon,lat,n\n1,2,"a\nb"\r3,4,c\n', 'lon,lat\r1,2\r3,4\r', 'lon,lat,n\n1,2,"a\nb,"\r3,4,c\n'):
        with pytest.raises(LoadError, match="carriage return"):
            load_csv(spark, config(write(text)))
    for text in ('"lon",lat,n\r\n1,2,"a\rb"\r\n', '"lon",lat,n\r\n1,2,"a\r\nb\rc"\r\n3,4,x\r\n', 'lon,lat,n\n1,2,"a""\rb"\n'):
        assert load_csv(spark, config(write(text))).totals["rejected"] == 0


def test_headers_only_need_the_first_record(spark, write):
    assert csv_headers(spark, write('﻿\n "a" ,b\n'.replace(' "a" ', '"a\nx"') + "1,2\n")) == ["a\nx", "b"]
    assert csv_headers(spark, write("a\tb c\n1\t2\n"), "\t") == ["a", "b c"]
    assert match_point_columns(["id", "X", "Latitude", "geom"]) == {"longitude": "X", "latitude": "Latitude", "geometry": "geom"}


def test_a_late_text_value_changes_the_column(spark, write):
    path = write("lon,lat,value\n" + "1,2,3\n" * 5000 + "1,2,late\n")
    records = read_records(spark, config(path))
    assert {f.name: f.kind for f in describe_csv(records)}["value"] == "string"


def test_poles_are_kept(spark, write):
    load = load_csv(spark, config(write("lon,lat\n0,90\n180,-90\n-180,85.1\n0,90.0001\n")))
    assert [r[0] for r in rows(load, load.table.lat)] == [90.0, -90.0, 85.1] and load.totals["rejected"] == 1


def read_field(text, at):
    """One field from a position: its value, whether its quoting is clean, where it ends, and if it never does."""
    if not text.startswith('"', at):
        end = min([p for p in (text.find(",", at), text.find("\n", at)) if p >= 0], default=len(text))
        return text[at:end], '"' not in text[at:end], end, False
    parts, clean, inside, at = [], True, True, at + 1
    while at < len(text) and (inside or text[at] not in ",\n"):
        if text[at] != '"':
            clean = clean and inside
            parts.append(text[at])
        else:
            # A quote that opens again stands for a quote.
            parts += [] if inside else ['"']
            inside = not inside
        at += 1
    return "".join(parts), clean, at, inside


def scan(text):
    """Records as ``(line, bad, cells)``, read field by field: the oracle below."""
    out, at = [], 0
    while at < len(text):
        start, cells, good = at, [], True
        while True:
            value, clean, at, endless = read_field(text, at)
            cells.append(value)
            good = good and clean
            if at >= len(text) or text[at] == "\n":
                break
            at += 1
        at += 1
        if text[start:at].strip(" \t\n"):
            out.append((text.count("\n", 0, start) + 1, not good, cells))
        if endless:
            return out, True
    return out, False


def test_records_against_a_character_scanner(spark, write):
    """Random quoting, line ends inside quotes and stray quotes; blocks of one line each way."""
    rng = random.Random(3)
    for trial in range(6):
        pieces = ["a", "1", '"', '""', ",", "\n", " ", "x,y", '"q"', '"l\nm"', '"\n"', "\n\n", '","']
        body = "".join(rng.choice(pieces) for _ in range(120))
        text = "h1,h2,h3\n" + body
        want, open_end = scan(text)
        if open_end:
            text += '"\n'
            want, open_end = scan(text)
        if open_end:
            continue
        path = write(text, f"t{trial}.csv")
        records = read_records(spark, SourceConfig(id="c", type="csv", path=path, longitude_field="h1", latitude_field="h2")).rows.orderBy("__row").collect()
        assert [r["__line"] for r in records] == [s for s, _, _ in want[1:]]
        for r, (_, bad, cells) in zip(records, want[1:]):
            if bad:
                assert r["__problem"] == "Malformed CSV quoting"
            elif len(cells) != 3:
                assert r["__problem"] == f"Expected 3 columns; found {len(cells)}"
            else:
                assert [c or "" for c in r["__cells"]] == cells


def test_splits_of_a_file_agree(spark, write):
    """Small blocks, so that records and quotes cross many of them."""
    rng = random.Random(11)
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["lon", "lat", "note"])
    notes = []
    for i in range(400):
        note = rng.choice(["plain", "two\nlines", 'q"uote', "a,b", "\n\n,\"\n", "x" * 50])
        notes.append(note)
        w.writerow([i % 180, i % 90, note])
    path = write(out.getvalue())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        load = load_csv(spark, config(path))
        assert [r[0] for r in rows(load, "note")] == notes
        lines, line = [], 2
        for n in notes:
            lines.append(f"csv.{line}")
            line += 1 + n.count("\n")
        assert [r[0] for r in rows(load, "point_id")] == lines
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_several_files_with_the_same_header(spark, tmp_path, write):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(3):
        (folder / f"part-{i}.csv").write_text(f"lon,lat,n\n{i},1,{i}\n{i},2,x{i}\n")
    load = load_csv(spark, config(str(folder)))
    assert rows(load, "point_id", "n") == [("csv.2", "0"), ("csv.3", "x0"), ("csv.2.2", "1"), ("csv.2.3", "x1"), ("csv.3.2", "2"), ("csv.3.3", "x2")]


def test_reported_lines_name_their_file(spark, tmp_path):
    folder = tmp_path / "several"
    folder.mkdir()
    (folder / "a.csv").write_text('lon,lat,n\n1,1,1\n1,1,"two\nlines"\nx,1,2\n1,1\nx,1,3\n')
    (folder / "b.csv").write_text("lon,lat,n\n" + "x,1,4\n" * 7 + "1,1,5\n")
    (folder / "c.csv").write_text("lon,lat,n\n1,1\n")
    found = [(r.reason, r["count"], [(f.rsplit("/", 1)[1], n) for f, n in zip(r.files, r.lines, strict=True)]) for r in load_csv(spark, config(str(folder))).issues.collect()]
    assert found == [("Longitude and latitude must be decimal numbers", 9, [("a.csv", 5), ("a.csv", 7), ("b.csv", 2), ("b.csv", 3), ("b.csv", 4)]),
                     ("Expected 3 columns; found 2", 2, [("a.csv", 6), ("c.csv", 2)])]
    (folder / "d.csv").write_text("lon,lat,n\n")
    assert load_csv(spark, config(str(folder / "d.csv"))).issues.count() == 0


def test_roles(spark):
    cases = {"clear": [("x", 0.8), ("y", 0.1), (None, 0.1)], "close": [("x", 0.5), ("y", 0.45), (None, 0.05)], "none": [(None, 0.9), ("x", 0.1)],
             "margin": [("x", 0.56), ("y", 0.44), (None, 0.0)]}
    data = [("f", role, c, p) for role, options in cases.items() for c, p in options]
    got = {r.role: r for r in resolve_role_predictions(spark.createDataFrame(data, "file string, role string, column string, probability double")).collect()}
    assert got["close"].column is None and got["none"].column is None
    # Two roles accept x, so neither keeps it.
    assert got["clear"].column is None and got["margin"].column is None
    alone = spark.createDataFrame([d for d in data if d[1] == "clear"], "file string, role string, column string, probability double")
    one = resolve_role_predictions(alone).first()
    assert one.column == "x" and [tuple(c) for c in one.candidates] == [("x", 0.8), (None, 0.1), ("y", 0.1)]


def test_files_with_other_headers_fail(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.csv").write_text("lon,lat,n\n1,1,1\n")
    (folder / "b.csv").write_text("lat,lon,n\n1,1,1\n")
    with pytest.raises(LoadError, match="same header"):
        load_csv(spark, config(str(folder)))


def test_cells_are_cut_out_once(spark, tmp_path, monkeypatch):
    """Types are found from written cells, not by putting the text together another time."""
    path = tmp_path / "spread.csv"
    path.write_text('x,y,note\n1,2,"a\nb"\n3,4,c\n"5",6,"d ""e"",\r\nf"\n', newline="")
    seen = []
    monkeypatch.setattr(csv_source, "describe_csv", lambda records, found=csv_source.describe_csv: (seen.append(records.rows.inputFiles()), found(records))[1])
    load = load_csv(spark, SourceConfig(id="s", type="csv", path=str(path), longitude_field="x", latitude_field="y"))
    assert seen[0] and all(f.endswith(".parquet") for f in seen[0])
    assert [(r.lon, r.lat, r.note) for r in load.table.df.orderBy("row_id").collect()] == [(1, 2, "a\nb"), (3, 4, "c"), (5, 6, 'd "e",\r\nf')]
