"""Pages, the paged service source, its filter documents, schemas and catalogs."""

import glob
import json
import sys
import urllib.parse

import pyarrow.parquet as pq
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pointloom.operators.integrity import (LoadError, check_coordinates, check_duplicate_ids, check_page_overrun, check_repeated_page, check_schema_drift, clamp_report,
                                           load_report, page_signatures)
from pointloom.sources.bounds import LoadBounds
from pointloom.sources.config import SourceConfig
from pointloom.sources.pages import (geojson_points, gml_layout, gml_points, infer_gml_schema, infer_json_schema, page_total, read_geojson_pages, read_gml_pages, saved_pages)
from pointloom.sources.service import (PAGE_ROWS, PagedRequest, PageRange, QueryFields, check_service_load, describe_page, plan_ranges, push_service_filter, read_feature_service, read_range,
                                       service_catalog, service_schema, service_source, service_url, stage_pages)
from pointloom.table import Field

# Workers do not import tests, so their functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GML = ('<?xml version="1.0"?><wfs:FeatureCollection xmlns:wfs="http://www.opengis.net/wfs/2.0" xmlns:gml="http://www.opengis.net/gml/3.2" '
       'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xmlns:a="urn:example:a" {extra}>{members}</wfs:FeatureCollection>')


def feature(i, properties=None, geometry=None, id=...):
    return {"type": "Feature", "id": f"s.{i}" if id is ... else id, "geometry": geometry or {"type": "Point", "coordinates": [i / 10, 50 + i / 100]},
            "properties": properties if properties is not None else {"n": i, "kind": "ab"[i % 2], "seen": f"2024-01-{i % 28 + 1:02d}T00:00:00Z", "ok": i % 3 == 0}}


def page(spark, *payloads):
    return spark.createDataFrame(list(enumerate(payloads)), "page bigint, payload string")


def collection(features, **more):
    return json.dumps({"type": "FeatureCollection", "features": features, **more})


def test_geojson_kinds_positions_and_nested_values(spark):
    multi = {"type": "MultiPoint", "coordinates": [[3, 4]]}
    features = [feature(0, {"n": None, "t": None, "s": "x", "o": {"k": [1, 2]}, "none": None, "id": 5}), feature(1, {"n": 2.5, "t": "2024-01-01", "s": "y", "b": True, "id": 6}, multi, id=7)]
    decoded = read_geojson_pages(page(spark, collection(features)))
    fields = infer_json_schema(decoded, [Field("s", "string")])
    assert {f.name: f.kind for f in fields} == {"s": "string", "n": "number", "t": "date", "o": "string", "none": "string", "b": "boolean", "id": "number"} and fields[0].name == "s"
    t = geojson_points(decoded, fields)
    got = t.df.orderBy("row_id").select("row_id", "point_id", "lon", "lat", "n", "o", "b", "id").collect()
    assert [tuple(r) for r in got] == [(0, "s.0", 0.0, 50.0, None, '{"k":[1,2]}', None, 5.0), (1, "7", 3.0, 4.0, 2.5, None, True, 6.0)]


@pytest.mark.parametrize("payload", ['{"type":"Feature"}', collection([feature(1, geometry={"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]})]),
                                     collection([feature(1, geometry={"type": "Polygon", "coordinates": []})])])
def test_geojson_that_is_no_points_fails(spark, payload):
    with pytest.raises(Exception, match="FeatureCollection|MultiPoint|Point geometries"):
        read_geojson_pages(page(spark, payload)).collect()


def test_values_that_do_not_fit_fail_the_load(spark):
    decoded = read_geojson_pages(page(spark, collection([feature(1, {"n": "twelve"})])))
    with pytest.raises(Exception, match="Invalid number in n"):
        geojson_points(decoded, [Field("n", "number")]).df.collect()
    assert geojson_points(read_geojson_pages(page(spark, collection([feature(1, {"n": " 12 "}), feature(2, {"n": " "})]))), [Field("n", "number")]).df.orderBy("row_id").select("n").collect() == [(12.0,), (None,)]


def test_gml_forms(spark):
    member = '<wfs:member><a:obs gml:id="o.1"><a:geom><gml:Point><gml:pos>1 2</gml:pos></gml:Point></a:geom><a:v xsi:nil="true"/><a:s/><a:d>2024-01-01</a:d></a:obs></wfs:member>'
    old = '<gml:featureMember><a:obs fid="o.2"><gml:boundedBy/><a:geom><gml:Point><gml:coordinates decimal=".">3,4</gml:coordinates></gml:Point></a:geom><a:v>2.5</a:v></a:obs></gml:featureMember>'
    many = ('<gml:featureMembers><a:obs gml:id="o.3"><a:geom><gml:MultiPoint><gml:pointMember><gml:Point><gml:pos>5 6</gml:pos></gml:Point></gml:pointMember></gml:MultiPoint></a:geom></a:obs>'
            '<a:obs gml:id="o.4"><a:geom><gml:MultiPoint><gml:pointMembers><gml:Point><gml:pos>7 8</gml:pos></gml:Point></gml:pointMembers></gml:MultiPoint></a:geom></a:obs></gml:featureMembers>')
    pages = page(spark, GML.format(extra='numberMatched="9"', members=member), GML.format(extra="", members=old), GML.format(extra="", members=many), GML.format(extra="", members=""))
    layout = gml_layout(GML.format(extra="", members=member))
    assert (layout.feature, layout.attributes, layout.geometries) == ("obs", ("v", "s", "d"), ("geom",))
    decoded = read_gml_pages(pages, layout)
    assert [(f.name, f.kind) for f in infer_gml_schema(decoded, layout)] == [("v", "string"), ("s", "string"), ("d", "date")]
    t = gml_points(decoded, [Field("v", "number"), Field("s", "string"), Field("d", "date")])
    got = [tuple(r) for r in t.df.orderBy("row_id").select("point_id", "lon", "lat", "v", "s").collect()]
    assert got == [("o.1", 1.0, 2.0, None, ""), ("o.2", 3.0, 4.0, 2.5, None), ("o.3", 5.0, 6.0, None, None), ("o.4", 7.0, 8.0, None, None)]
    assert gml_points(read_gml_pages(pages, layout, "yx"), []).df.orderBy("row_id").select("lon", "lat").first() == (2.0, 1.0)
    assert [r.total for r in page_total(pages).orderBy("page").collect()] == [9, None, None, None]
    bad = '<ows:ExceptionReport xmlns:ows="u"><ows:Exception>broken &amp; gone</ows:Exception></ows:ExceptionReport>'
    with pytest.raises(Exception, match="broken"):
        read_gml_pages(page(spark, bad), layout).collect()
    with pytest.raises(ValueError, match="broken"):
        gml_layout(bad)


def test_saved_pages_keep_file_order(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"page-{i}.json").write_text(collection([feature(10 * i), feature(10 * i + 1)], totalFeatures=6))
    pages = saved_pages(spark, str(tmp_path))
    t = geojson_points(read_geojson_pages(pages), [Field("n", "number")])
    assert [r[0] for r in t.df.orderBy("row_id").select("lon").collect()] == [0.0, 0.1, 1.0, 1.1, 2.0, 2.1]
    assert [r.total for r in page_total(pages).collect()] == [6, 6, 6]


# --- requests -------------------------------------------------------------

def test_addresses_keep_other_arguments():
    url = service_url("https://example.test/ows?token=a%20b&REQUEST=x", "2.0.0", "GetFeature", {"count": "5"})
    query = urllib.parse.parse_qs(urllib.parse.urlsplit(url).query)
    assert query == {"token": ["a b"], "service": ["WFS"], "version": ["2.0.0"], "request": ["GetFeature"], "count": ["5"]}


def test_filter_documents():
    names = QueryFields("app:t", "app:g", {"app": "urn:a", "gml": "no", "1bad": "no"}, {"n": "app:n"})
    rules = [{"field": "n", "kind": "number", "op": "gte", "value": "1e1"}, {"field": "s<", "kind": "string", "op": "contains", "value": "50*!?&"}, {"field": "s", "kind": "string", "op": "notnull"}]
    text = push_service_filter("2.0.0", LoadBounds(("2024-01-01", "2024-01-02T00:00:00+01:00"), (-5, 50, 1.5, 60)), names, rules)
    for part in ("<fes:And>", "<fes:PropertyIsGreaterThanOrEqualTo><fes:ValueReference>app:n</fes:ValueReference><fes:Literal>10</fes:Literal>", "s&lt;", "*50!*!!!?&amp;*", 'escapeChar="!"',
                 "<fes:Not><fes:PropertyIsNull>", "2024-01-01T23:00:00.000Z", "<gml:lowerCorner>-5 50</gml:lowerCorner>", 'xmlns:app="urn:a"', 'xmlns:gml="http://www.opengis.net/gml/3.2"'):
        assert part in text
    assert "1bad" not in text
    old = push_service_filter("1.0.0", LoadBounds(box=(-5, 50, 1.5, 60)), names, [rules[1]])
    assert 'escape="!"' in old and "<gml:coordinates>-5,50 1.5,60</gml:coordinates>" in old and "ogc:PropertyName" in old
    single = push_service_filter("1.1.0", LoadBounds(), names, [rules[2]])
    assert "<ogc:And>" not in single and push_service_filter("2.0.0", LoadBounds(), names) is None
    with pytest.raises(LoadError):
        push_service_filter("2.0.0", LoadBounds(("2024-01-01", "2024-01-02")), QueryFields())
    with pytest.raises(LoadError):
        push_service_filter("2.0.0", LoadBounds(box=(0, 0, 1, 1)), QueryFields())


XSD = """<xsd:schema xmlns:xsd="http://www.w3.org/2001/XMLSchema" xmlns:gml="http://www.opengis.net/gml/3.2" xmlns:app="urn:a" targetNamespace="urn:a" elementFormDefault="qualified">
<xsd:complexType name="otherType"><xsd:sequence><xsd:element name="wrong" type="xsd:int"/></xsd:sequence></xsd:complexType>
<xsd:complexType name="obsType"><xsd:complexContent><xsd:extension><xsd:sequence><xsd:element name="n" type="xsd:double"/><xsd:element name="kind" type="xsd:string"/>
<xsd:element name="seen" type="xsd:dateTime"/><xsd:element name="ok" type="xsd:boolean"/><xsd:element name="geom" type="gml:PointPropertyType"/></xsd:sequence></xsd:extension></xsd:complexContent></xsd:complexType>
<xsd:element name="obs" type="app:obsType"/></xsd:schema>"""


def service(**more):
    return SourceConfig(**{"id": "s", "name": "s", "layer": "app:obs", "page_size": 4, "max_parallel_requests": 3, **more})


def test_declared_schema():
    fields, names, layout = service_schema(XSD, service())
    assert [(f.name, f.kind) for f in fields] == [("n", "number"), ("kind", "string"), ("seen", "date"), ("ok", "boolean")]
    assert (names.time, names.geometry, names.attributes["n"]) == ("app:seen", "app:geom", "app:n") and layout.geometries == ("geom",)
    two_dates = XSD.replace('name="kind" type="xsd:string"', 'name="kind" type="xsd:date"')
    assert service_schema(two_dates, service())[1].time == ""


def test_catalog(spark):
    doc = """<WFS_Capabilities xmlns="http://www.opengis.net/wfs/2.0" xmlns:ows="http://www.opengis.net/ows/1.1"><ows:OperationsMetadata><ows:Operation name="GetFeature">
    <ows:Parameter name="outputFormat"><ows:AllowedValues><ows:Value>gml</ows:Value><ows:Value>application/json</ows:Value></ows:AllowedValues></ows:Parameter></ows:Operation></ows:OperationsMetadata>
    <FeatureTypeList><FeatureType><Name>a:x</Name><Title>Trees</Title></FeatureType><FeatureType><Name>a:y</Name><OutputFormats><Format>csv</Format></OutputFormats></FeatureType></FeatureTypeList></WFS_Capabilities>"""
    rows = service_catalog(spark.createDataFrame([(doc,)], "payload string")).orderBy("name").collect()
    assert [(r.name, r.title, list(r.formats)) for r in rows] == [("a:x", "Trees", ["gml", "application/json"]), ("a:y", "a:y", ["csv"])]


def answers(total, cap=None, hits=True, overlap=0):
    """A function that answers page requests from numbered features."""
    def fetch(params):
        if params.get("resultType") == "hits":
            if not hits:
                raise OSError("no hits")
            return f'<FeatureCollection numberMatched="{total}"/>'
        start, count = int(params["startIndex"]), int(params["count"])
        count = min(count, cap or count)
        return collection([feature(i) for i in range(max(0, start - overlap), min(total, start + count - overlap if overlap else start + count))])
    return fetch


@pytest.mark.parametrize("total,cap,hits,end", [(0, None, True, "empty"), (1, None, True, "short"), (19, None, True, "empty"), (19, 3, True, "empty"), (19, None, False, "empty"), (40, 1, True, "empty"),
                                                (20, None, True, "short")])
def test_paging_reads_everything_once(spark, total, cap, hits, end):
    load = read_feature_service(spark, service(paging_end=end), answers(total, cap, hits))
    ids = sorted(int(r[0][2:]) for r in load.table.df.select("point_id").collect())
    assert ids == list(range(total))
    if total:
        check_service_load(load)
        assert [r[0] for r in load.table.df.orderBy("row_id").select("row_id").collect()] == list(range(total))


def test_limits_and_ranges(spark):
    load = read_feature_service(spark, service(limit=10), answers(19))
    assert load.table.df.count() == 10 and load_report(load.table, load.limit).first().truncated
    assert plan_ranges(4, 19, 4, None, 3) == [PageRange(4, 12), PageRange(12, 20)]
    assert plan_ranges(0, None, 4, 100, 3) == [PageRange(0, 32), PageRange(32, 64), PageRange(64, 96)]
    assert plan_ranges(0, 500, 4, 8, 3)[-1].end == 8 and plan_ranges(20, 19, 4, None, 3) == [PageRange(20, 52)]
    request = PagedRequest.of(service(paging_end="short"), None)
    assert [p[0] for p in read_range(answers(100, cap=1), request, PageRange(0, 100))] == [0]
    with pytest.raises(LoadError, match="for a request of 4"):
        list(read_range(lambda p: collection([feature(i) for i in range(9)]), request, PageRange(0, 100)))


@pytest.mark.parametrize("hits", [True, False])
@pytest.mark.parametrize("cap", [None, 3])
def test_every_offset_is_asked_once(spark, tmp_path, hits, cap):
    log = tmp_path / "asked"

    def fetch(params, log=str(log), answer=answers(150, cap, hits)):
        if "startIndex" in params:
            with open(log, "a") as out:
                out.write(params["startIndex"] + "\n")
        return answer(params)

    load = read_feature_service(spark, service(), fetch)
    assert load.table.df.count() == 150
    check_service_load(load)
    asked = log.read_text().split()
    assert len(asked) == len(set(asked))


def test_short_pages_leave_one_run_without_holes(spark):
    load = read_feature_service(spark, service(paging_end="short", page_size=10), answers(100, cap=5))
    assert sorted(r[0] for r in load.table.df.select("row_id").collect()) == list(range(5))
    late = lambda p: answers(100, cap=5 if int(p.get("startIndex", 0)) == 40 else None)(p)
    load = read_feature_service(spark, service(paging_end="short", page_size=10), late)
    assert sorted(r[0] for r in load.table.df.select("row_id").collect()) == list(range(45))


def test_new_attributes_fail_the_load(spark):
    def drifting(params):
        return answers(12)(params).replace('"n"', '"m"') if int(params.get("startIndex", 0)) >= 8 else answers(12)(params)

    with pytest.raises(LoadError, match="m"):
        read_feature_service(spark, service(), drifting)
    member = '<wfs:member><obs gml:id="o.{0}"><geom><gml:Point><gml:pos>1 2</gml:pos></gml:Point></geom><{1}>1</{1}></obs></wfs:member>'
    head = '<wfs:FeatureCollection xmlns:wfs="w" xmlns:gml="g">'

    def gml(params):
        at = int(params.get("startIndex", 0))
        return head + "".join(member.format(i, "n" if i < 8 else "odd") for i in range(at, min(12, at + int(params.get("count", 0))))) + "</wfs:FeatureCollection>"

    with pytest.raises(LoadError, match="odd"):
        read_feature_service(spark, service(format="gml"), gml)


def test_a_service_without_offsets_is_noticed_whatever_else_a_page_says(spark):
    def stuck(params, seen=[0]):  # noqa: B006
        if params.get("resultType") == "hits":
            return '<FeatureCollection numberMatched="8"/>'
        seen[0] += 1
        return collection([feature(i) for i in range(4)], timeStamp=f"{params['startIndex']}-{seen[0]}")

    with pytest.raises(LoadError, match="repeats"):
        check_service_load(read_feature_service(spark, service(limit=8), stuck))


@pytest.mark.parametrize("hits", [True, False])
@pytest.mark.parametrize("features", [4, 1])
def test_a_service_without_offsets_and_limit_ends_within_a_wave(spark, tmp_path, hits, features):
    log = tmp_path / "asked"

    def stuck(params, log=str(log)):
        if params.get("resultType") == "hits":
            if not hits:
                raise OSError("no hits")
            return '<FeatureCollection numberMatched="4000"/>'
        with open(log, "a") as out:
            out.write("x\n")
        return collection([feature(i) for i in range(features)], timeStamp=params["startIndex"])

    with pytest.raises(LoadError, match="repeats"):
        read_feature_service(spark, service(), stuck)
    assert len(log.read_text().split()) <= 1 + 2 * service().max_parallel_requests


def test_a_repeat_between_two_waves_is_noticed(spark):
    def late(params, turn=36):
        start = int(params.get("startIndex", 0))
        return answers(400, hits=False)({**params, "startIndex": str(min(start, turn))})

    with pytest.raises(LoadError, match="repeats"):
        read_feature_service(spark, service(max_parallel_requests=1), late)


def test_gml_pages_are_compared_by_their_features():
    member = '<wfs:member><obs id="o.{0}"><s>{0}</s></obs></wfs:member>'
    page_of = lambda ids, stamp: f'<c xmlns:wfs="w" at="{stamp}">' + "".join(member.format(i) for i in ids) + "</c>"
    assert describe_page(page_of([1, 2, 3], 1)) == describe_page(page_of([1, 2, 3], 2)) and describe_page(page_of([1, 2, 3], 1))[0] == 3
    assert describe_page(page_of([1, 2, 3], 1))[1] != describe_page(page_of([1, 2, 4], 1))[1] and describe_page(page_of([], 1)) == (0, "")


def test_long_preambles_hide_nothing(spark):
    padding = "<!-- " + "x" * 20_000 + " -->"
    layout = gml_layout('<FeatureCollection><member><obs><geom><Point><pos>1 2</pos></Point></geom></obs></member></FeatureCollection>')
    with pytest.raises(Exception, match="broken"):
        read_gml_pages(page(spark, f'<?xml version="1.0"?>{padding}<ows:ExceptionReport xmlns:ows="u">broken</ows:ExceptionReport>'), layout).collect()
    assert page_total(page(spark, f'{padding}<FeatureCollection numberMatched="7"/>')).first().total == 7
    talk = '<FeatureCollection><member><obs><geom><Point><pos>1 2</pos></Point></geom><s>an ExceptionReport</s></obs></member></FeatureCollection>'
    assert read_gml_pages(page(spark, talk), layout).count() == 1


def test_overlapping_pages_fail(spark):
    load = read_feature_service(spark, service(max_parallel_requests=1), answers(12, overlap=1))
    with pytest.raises(LoadError):
        check_service_load(load)


def test_service_filter_is_sent_and_schema_is_used(spark):
    seen = []

    def fetch(params):
        return answers(5)(params)

    config = service(load_rules=[{"field": "n", "kind": "number", "op": "gte", "value": "2"}])
    load = read_feature_service(spark, config, fetch, LoadBounds(box=(0, 0, 10, 60)), described=XSD)
    assert [f.name for f in load.table.fields] == ["n", "kind", "seen", "ok"] and load.table.time_field == "seen"
    request = PagedRequest.of(config, push_service_filter("2.0.0", LoadBounds(box=(0, 0, 10, 60)), service_schema(XSD, config)[1], config.load_rules))
    request.page(lambda p: seen.append(p) or collection([]), 8, 4)
    assert seen[0]["startIndex"] == "8" and seen[0]["count"] == "4" and "app:n" in seen[0]["filter"] and seen[0]["typeNames"] == "app:obs"
    with pytest.raises(ValueError):
        read_feature_service(spark, service(load_rules=[{"field": "n", "kind": "string", "op": "null"}]), fetch, described=XSD)
    for bad in (dict(page_size=0), dict(limit=0), dict(limit=True), dict(max_parallel_requests=101), dict(paging_end="never"), dict(layer=" "), dict(type="ftp")):
        with pytest.raises(ValueError):
            service(**bad).check()


# --- checks ---------------------------------------------------------------

def test_checks_on_tables(table, spark):
    t = table("n double", [(1.0,), (2.0,), (3.0,)], ids=["a", None, "a"], lon=[0.0, 200.0, 0.0], lat=[86.0, 0.0, -85.05112878])
    with pytest.raises(LoadError, match="Repeated feature ID a"):
        check_duplicate_ids(t)
    with pytest.raises(LoadError, match="longitude 200"):
        check_coordinates(t)
    assert clamp_report(t).first()[0] == 1 and load_report(t, 3).first().missing_ids and load_report(t, 3).first().truncated
    pages = spark.createDataFrame([(0, 0, "x"), (0, 1, "y"), (1, 2, "x"), (1, 3, "y"), (2, 4, "z")], "page bigint, at bigint, v string")
    signatures = page_signatures(pages, "page", "at", ["v"])
    with pytest.raises(LoadError, match="Page 1 repeats"):
        check_repeated_page(signatures, "page")
    with pytest.raises(LoadError):
        check_page_overrun(signatures, "page", 1)
    check_page_overrun(signatures, "page", 2)
    drift = spark.createDataFrame([({"a": "1"},), ({"b": "2"},)], "p map<string,string>")
    check_schema_drift(drift, "p", ["a", "b"])
    with pytest.raises(LoadError, match="b"):
        check_schema_drift(drift, "p", ["a"])
    variants = spark.range(1).select(F.parse_json(F.lit('{"a":1,"new":2}')).alias("p"))
    with pytest.raises(LoadError, match="new"):
        check_schema_drift(variants, "p", ["a"])


def test_pages_leave_a_worker_one_at_a_time():
    """Ten thousand pages of text must not gather in a worker before Spark gets them."""
    asked = []

    def fetch(params):
        asked.append(params)
        return answers(400)(params)

    request = PagedRequest.of(service(), None)
    reader = service_source(fetch, request, [PageRange(0, 400)])({}).reader(None)
    given = reader.read(reader.partitions()[0])
    batch = next(given)
    assert len(asked) == 1 and batch.num_rows == 1 and batch.schema.names == [c.split()[0] for c in PAGE_ROWS.split(", ")]
    assert 1 + sum(b.num_rows for b in given) == len(list(read_range(answers(400), request, PageRange(0, 400))))


def test_staged_pages_are_kept_in_small_row_groups(spark, tmp_path):
    """A reader holds thousands of rows of a row group at once, and a row is a whole page."""
    def fetch(params):
        import random

        if params.get("resultType") == "hits":
            return '<c numberMatched="60"/>'
        at, count = int(params["startIndex"]), int(params["count"])
        numbers = random.Random(at)
        ids = range(at, min(at + count, 60))
        return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "id": f"f{i}", "properties": {"note": "%0250000x" % numbers.getrandbits(1_000_000)},
                                                                      "geometry": {"type": "Point", "coordinates": [1, 2]}} for i in ids]})

    request = PagedRequest.of(service(page_size=2), None)
    pages = stage_pages(spark, fetch, request, request.page(fetch, 0, 2), 1, str(tmp_path / "p"))
    assert pages.agg(F.sum("features")).first()[0] == 60
    files = [pq.ParquetFile(f).metadata for f in glob.glob(str(tmp_path / "p" / "*.parquet"))]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(groups) >= 30 and max(groups) <= 16
