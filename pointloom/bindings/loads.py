"""Loading: CSV files and service pages that Spark derives from the given tables, and their checks."""

from __future__ import annotations

import glob

from pyspark.sql import DataFrame, functions as F

from ..operators.integrity import (bad_coordinates, clamp_report, dataset_bounds, duplicate_ids, load_report, missing_id_warning, page_overruns,
                                   page_signatures, repeated_pages, schema_drift, truncation_flag, union_bounds)
from ..plans.run import AnalysisRun, run_analysis, run_tables
from ..plans.spec import AnalysisSpec, SavedChart, SeriesMap, SourceAnalysis
from ..operators.charts import ChartSpec
from ..sinks.bundle import export_bundle, import_bundle
from ..sinks.export import write_points
from ..sources.bounds import LoadBounds
from ..sources.config import SourceConfig
from ..sources.csv import CsvRecords, decode_point_geojson, decode_point_wkt, import_report, infer_csv_types, load_csv, stage_rows, validate_rows, with_texts
from ..sources.generate import observations
from ..sources.pages import (GmlLayout, geojson_points, gml_points, infer_gml_schema, infer_json_schema, page_total, read_geojson_pages,
                             read_gml_pages)
from ..sources.roles import resolve_role_predictions
from ..sources.service import check_service_load, read_feature_service, service_catalog
from ..operators.expressions import rule
from ..operators.picking import pick_rectangle
from ..session import scratch_folder
from ..table import Field
from .charts import CUSTOMER, customer
from .filters import NESTED, NESTED_SQL
from .rows import PLACED, VALID
from .tables import LINEITEM, POINTS, categories_sql, edges_sql, histogram_sql, inside, lineitem, points, read, register

# --- rows of text, some of them damaged -----------------------------------

TEXT_HEADERS = ("lon", "lat", "when", "value", "label", "active", "blank")


def text_records(spark, folder, **config) -> CsvRecords:
    """Events written as CSV cells; the row number decides what is wrong with a row."""
    df = points(spark, folder).df
    n = F.col("row_id")
    cells = [F.when(n % 31 == 3, F.lit("  ")).when(n % 31 == 5, F.lit("12,5")).when(n % 31 == 7, F.lit("181.5")).otherwise(F.col("lon").cast("string")),
             F.when(n % 37 == 4, F.lit("")).otherwise(F.col("lat").cast("string")),
             F.when(n % 41 == 6, F.lit("2024-02-30")).when(n % 43 == 8, F.lit("")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")),
             F.when(n % 47 == 9, F.lit("")).otherwise(F.col("value").cast("string")),
             F.concat(F.col("category"), F.lit(' "quoted", and\nbroken')),
             F.when(n % 53 == 10, F.lit("")).otherwise(F.initcap(F.col("active").cast("string"))), F.lit("  ")]
    problem = F.when(n % 59 == 11, F.lit("Malformed CSV quoting")).when(n % 61 == 12, F.lit("Expected 7 columns; found 6"))
    rows = df.select(n.alias("__row"), F.lit(0).cast("bigint").alias("__file"), (n + 2).alias("__line"), problem.alias("__problem"),
                     F.when(problem.isNull(), F.array(*cells)).alias("__cells"), F.lit(True).alias("__padded"))
    return CsvRecords(TEXT_HEADERS, with_texts(rows), SourceConfig(id="t", type="csv", path="-", longitude_field="lon", latitude_field="lat",
                                                       time_field="when", **config))


@register("infer_csv_types", "SELECT * FROM (VALUES ('lon', TRUE, FALSE, FALSE), ('lat', TRUE, TRUE, FALSE), ('when', TRUE, FALSE, FALSE), ('value', TRUE, TRUE, FALSE), "
                             "('label', TRUE, FALSE, FALSE), ('active', TRUE, FALSE, TRUE), ('blank', FALSE, FALSE, FALSE)) "
                             "t(\"column\", present, is_number, is_boolean) WHERE (SELECT count(*) FROM events) > 0")
def inferred(spark, folder):
    return infer_csv_types(text_records(spark, folder))


TEXT_FIELDS = (Field("lon", "string"), Field("lat", "number"), Field("when", "date"), Field("value", "number"), Field("label", "string"),
               Field("active", "boolean"), Field("blank", "string"))
TEXT_BOUNDS = LoadBounds(time=("2024-01-02", "2024-01-28T23:59:59Z"), box=(-150, -80, 160, 88))
TEXT_RULES = [{"field": "value", "kind": "number", "op": "lt", "value": "60"}]
_N = "row_id"
REASON_SQL = f"""CASE WHEN {_N} % 59 = 11 THEN 'Malformed CSV quoting' WHEN {_N} % 61 = 12 THEN 'Expected 7 columns; found 6'
 WHEN {_N} % 31 = 3 THEN 'Missing longitude in "lon"' WHEN {_N} % 37 = 4 THEN 'Missing latitude in "lat"'
 WHEN {_N} % 31 = 5 THEN 'Longitude and latitude must be decimal numbers'
 WHEN {_N} % 31 = 7 THEN 'Coordinate is invalid: longitude 181.5, latitude ' || CASE WHEN lat = floor(lat) THEN CAST(CAST(lat AS BIGINT) AS VARCHAR) ELSE CAST(lat AS VARCHAR) END || '. Expected finite WGS84 degrees.'
 WHEN {_N} % 41 = 6 THEN 'Invalid ISO 8601 time in "when"'
 WHEN {_N} % 47 <> 9 AND value < 60 AND {_N} % 43 = 8 THEN 'Missing time in "when" required by the selected time bounds' END"""
OUTSIDE_SQL = (f"NOT ({_N} % 47 <> 9 AND value < 60 AND {_N} % 43 <> 8 AND ts >= TIMESTAMP '2024-01-02' AND date_trunc('milliseconds', ts) <= TIMESTAMP '2024-01-28 23:59:59' "
               "AND lon BETWEEN -150 AND 160 AND lat BETWEEN -80 AND 88)")
JUDGED_SQL = f"(SELECT *, {REASON_SQL} AS reject_reason, {OUTSIDE_SQL} AS outside FROM {POINTS} p)"


def judged(spark, folder) -> DataFrame:
    return validate_rows(text_records(spark, folder, load_rules=TEXT_RULES), TEXT_FIELDS, TEXT_BOUNDS)


@register("validate_rows", f"SELECT row_id, reject_reason, reject_reason IS NULL AND outside AS filtered, CASE WHEN reject_reason IS NULL AND {_N} % 47 <> 9 THEN value END AS value, "
                           f"CASE WHEN reject_reason IS NULL AND {_N} % 53 <> 10 THEN active END AS active FROM {JUDGED_SQL} j")
def validated(spark, folder):
    """First failing rule of every row, or whether bounds and rules leave it out."""
    good = F.col("reject_reason").isNull()
    return judged(spark, folder).select("row_id", "reject_reason", "filtered", F.when(good, F.col("value")).alias("value"), F.when(good, F.col("active")).alias("active"))


@register("import_totals", f"SELECT count(*) AS total, count(*) FILTER (reject_reason IS NULL AND NOT outside) AS imported, count(*) FILTER (reject_reason IS NOT NULL) AS rejected, "
                           f"count(*) FILTER (reject_reason IS NULL AND outside) AS filtered FROM {JUDGED_SQL} j")
def totals(spark, folder):
    return import_report(stage_rows(judged(spark, folder), scratch_folder(spark)))[0]


@register("import_report", f"SELECT reject_reason AS reason, count(*) AS count, array_to_string(list_slice(list(row_id + 2 ORDER BY row_id), 1, 5), ',') AS lines FROM {JUDGED_SQL} j WHERE reject_reason IS NOT NULL GROUP BY 1")
def issues(spark, folder):
    """Every reason with its count and first five lines."""
    return import_report(stage_rows(judged(spark, folder), scratch_folder(spark)))[1].select("reason", "count", F.array_join("lines", ",").alias("lines"))


def _decoded(spark, folder, text, decode) -> DataFrame:
    lon, lat, problem = decode(F.col("text"), "geom")
    rows = points(spark, folder).df.select("row_id", text.alias("text")).select("row_id", lon.alias("lon"), lat.alias("lat"), problem.alias("problem"))
    good = F.col("problem").isNull()
    return rows.select("row_id", F.when(good, F.col("lon")).alias("lon"), F.when(good, F.col("lat")).alias("lat"), "problem")


def _decoded_sql(problem: str) -> str:
    return (f"SELECT row_id, CASE WHEN problem IS NULL THEN lon END AS lon, CASE WHEN problem IS NULL THEN lat END AS lat, problem "
            f"FROM (SELECT *, {problem} AS problem FROM {POINTS} p)")


@register("decode_point_wkt", _decoded_sql("CASE WHEN row_id % 7 IN (2, 5) THEN 'Expected WKT POINT (longitude latitude) in \"geom\"' END"))
def wkt(spark, folder):
    """Points as WKT text in any case and spacing, some of them no points."""
    lon, lat, n = F.col("lon").cast("string"), F.col("lat").cast("string"), F.col("row_id") % 7
    text = (F.when(n == 2, F.concat(F.lit("POINT ("), lon, F.lit(" "), lat, F.lit(" 3)"))).when(n == 5, F.concat(F.lit("POINT (0x1F "), lat, F.lit(")")))
            .when(n == 3, F.concat(F.lit("  point("), lon, F.lit("\t"), lat, F.lit(" )\n"))).otherwise(F.concat(F.lit("POINT ("), lon, F.lit(" "), lat, F.lit(")"))))
    return _decoded(spark, folder, text, decode_point_wkt)


@register("decode_point_geojson", _decoded_sql("CASE WHEN row_id % 7 = 2 THEN 'Invalid GeoJSON JSON in \"geom\"' WHEN row_id % 7 IN (3, 5) THEN 'Expected a GeoJSON Point geometry in \"geom\"' END"))
def geojson_cells(spark, folder):
    """Points as GeoJSON text, some of it broken or of another kind."""
    n = F.col("row_id") % 7
    pair = F.concat(F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"))
    text = (F.when(n == 2, F.lit('{"type":"Point",')).when(n == 3, F.concat(F.lit('{"type":"LineString","coordinates":['), pair, F.lit("]}")))
            .when(n == 5, F.lit('{"type":"Point","coordinates":["1",2]}')).otherwise(F.concat(F.lit('{"coordinates":['), pair, F.lit(',5], "type" : "Point"}'))))
    return _decoded(spark, folder, text, decode_point_geojson)


# --- CSV files ------------------------------------------------------------

def write_text(spark, df: DataFrame) -> str:
    path = scratch_folder(spark)
    df.write.option("header", True).option("quote", '"').option("escape", '"').option("lineSep", "\r\n").csv(path)
    return path


CSV_SQL = ("SELECT count(*) AS rows, count(DISTINCT event_id) AS ids, min(event_id)::DOUBLE AS first, max(event_id)::DOUBLE AS last, round(sum(value), 2) AS value, "
           "count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_id % 9 = 0) AS gaps, min(ts_ms) AS start, max(ts_ms) AS \"end\", "
           "0::BIGINT AS rejected FROM (SELECT *, date_trunc('milliseconds', ts) AS ts_ms FROM events)")


def _csv_summary(load) -> DataFrame:
    return load.table.df.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("event_id").alias("ids"), F.min("event_id").alias("first"), F.max("event_id").alias("last"),
        F.round(F.sum("value"), 2).alias("value"), F.count_if(F.col("kind") == "error").alias("errors"), F.count_if(F.col("gap").isNull()).alias("gaps"),
        F.min("ts").alias("start"), F.max("ts").alias("end")).withColumn("rejected", F.lit(load.totals["rejected"]).cast("bigint"))


def _csv_events(spark, folder, note) -> DataFrame:
    df = read(spark, folder, "events")
    lon, lat = (F.col("event_id") % 360 - 180).alias("x"), (F.col("event_id") % 180 - 90).alias("y")
    return df.select(lon, lat, "event_id", "value", F.col("event_type").alias("kind"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"),
                     F.when(F.col("event_id") % 9 != 0, F.col("props")).alias("gap"), note.alias("note"))


CSV_CONFIG = dict(id="csv", type="csv", longitude_field="x", latitude_field="y", time_field="ts")


@register("read_csv_points", CSV_SQL)
def csv_round_trip(spark, folder):
    """All events written as CSV files and loaded again: types, quoting, gaps and times survive."""
    path = write_text(spark, _csv_events(spark, folder, F.lit('plain "quoted", text')))
    return _csv_summary(load_csv(spark, SourceConfig(path=path, **CSV_CONFIG)))


@register("read_csv_multiline", CSV_SQL)
def csv_multiline(spark, folder):
    """The same with line ends inside quoted cells, so that records span lines."""
    note = F.when(F.col("event_id") % 5 == 0, F.lit('first\nsecond "quoted"\r\n,third')).otherwise(F.lit("x"))
    path = write_text(spark, _csv_events(spark, folder, note))
    return _csv_summary(load_csv(spark, SourceConfig(path=path, **CSV_CONFIG)))


# --- service pages --------------------------------------------------------

PAGE = 1000


def _paged(table, feature) -> DataFrame:
    """Rows of text, a thousand features each; a page is bounded by its size."""
    rows = table.df.select(F.floor(F.col("row_id") / PAGE).cast("bigint").alias("page"), F.struct("row_id", feature.alias("f")).alias("r"))
    return rows.groupBy("page").agg(F.array_sort(F.collect_list("r")).alias("fs")).select("page", F.transform("fs", lambda r: r["f"]).alias("fs"))


def geojson_pages(spark, folder) -> DataFrame:
    table = points(spark, folder)
    properties = F.struct("category", "value", "reading", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("ts"), "active",
                          F.struct("k").alias("nested"))
    multi = F.concat(F.lit('{"type":"MultiPoint","coordinates":[['), F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit("]]}"))
    point = F.concat(F.lit('{"type":"Point","coordinates":['), F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit(",7]}"))
    feature = F.concat(F.lit('{"type":"Feature","id":"'), F.col("point_id"), F.lit('","geometry":'), F.when(F.col("row_id") % 3 == 0, multi).otherwise(point),
                       F.lit(',"properties":'), F.to_json(properties, {"ignoreNullFields": "false"}), F.lit("}"))
    return _paged(table, feature).select("page", F.concat(F.lit('{"type":"FeatureCollection","numberMatched":'), (F.col("page") * 10 + 3).cast("string"),
                                                          F.lit(',"features":['), F.array_join("fs", ","), F.lit("]}")).alias("payload"))


def gml_pages(spark, folder) -> DataFrame:
    tag = lambda n, c: F.concat(F.lit(f"<app:{n}>"), c, F.lit(f"</app:{n}>"))
    gap = F.coalesce(tag("reading", F.col("reading").cast("string")), F.lit('<app:reading xsi:nil="true"/>'))
    place = F.concat(F.lit('<app:geom><gml:Point><gml:pos srsDimension="2">'), F.col("lat").cast("string"), F.lit(" "), F.col("lon").cast("string"), F.lit("</gml:pos></gml:Point></app:geom>"))
    multi = F.concat(F.lit("<app:geom><gml:MultiPoint><gml:pointMember><gml:Point><gml:coordinates>"), F.col("lat").cast("string"), F.lit(","), F.col("lon").cast("string"),
                     F.lit("</gml:coordinates></gml:Point></gml:pointMember></gml:MultiPoint></app:geom>"))
    feature = F.concat(F.lit('<wfs:member><app:obs gml:id="'), F.col("point_id"), F.lit('">'), F.when(F.col("row_id") % 3 == 0, multi).otherwise(place),
                       tag("category", F.col("category")), gap, tag("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")),
                       tag("active", F.when(F.col("active"), F.lit("1")).otherwise(F.lit("false"))), F.lit("</app:obs></wfs:member>"))
    head = ('<?xml version="1.0" encoding="UTF-8"?><wfs:FeatureCollection xmlns:wfs="http://www.opengis.net/wfs/2.0" xmlns:gml="http://www.opengis.net/gml/3.2" '
            'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xmlns:app="urn:example:app" numberMatched="')
    return _paged(points(spark, folder), feature).select("page", F.concat(F.lit(head), (F.col("page") * 10 + 3).cast("string"), F.lit('">'), F.array_join("fs", ""),
                                                                          F.lit("</wfs:FeatureCollection>")).alias("payload"))


PAGE_FIELDS = (Field("category", "string"), Field("reading", "number"), Field("ts", "date"), Field("active", "boolean"))
PAGES_SQL = (f"SELECT (row_id // {PAGE}) * 2147483648 + row_id % {PAGE} AS row_id, point_id, lon, lat, category, reading, date_trunc('milliseconds', ts) AS ts, active FROM {POINTS} p")
SHOWN = ("row_id", "point_id", "lon", "lat", "category", "reading", "ts", "active")


@register("read_geojson_pages", PAGES_SQL.replace("active FROM", "active, value, '{\"k\":' || CAST(k::BIGINT AS VARCHAR) || '}' AS nested FROM"))
def geojson(spark, folder):
    """Typed points of GeoJSON pages, nested properties kept as JSON text."""
    fields = (*PAGE_FIELDS, Field("value", "number"), Field("nested", "string"))
    return geojson_points(read_geojson_pages(geojson_pages(spark, folder)), fields).df


@register("infer_json_schema", "SELECT * FROM (VALUES ('category', 'string'), ('value', 'number'), ('reading', 'number'), ('ts', 'date'), ('active', 'boolean'), ('nested', 'string')) t(name, kind) "
                               "WHERE (SELECT count(*) FROM events) > 0")
def json_schema(spark, folder):
    """Kinds found in the pages, shown for every attribute that occurs in them."""
    features = read_geojson_pages(geojson_pages(spark, folder))
    kinds = {f.name: f.kind for f in infer_json_schema(features)}
    names = features.select(F.explode(F.map_keys("__properties")).alias("name")).distinct()
    return names.select("name", F.element_at(F.create_map(*[F.lit(v) for pair in kinds.items() for v in pair]), F.col("name")).alias("kind"))


class WrittenPages:
    """A service over pages that Spark has written as one file for each offset; other offsets have no features."""

    def __init__(self, folder: str, total: int):
        self.folder, self.total = folder.removeprefix("file:"), total

    def __call__(self, params) -> str:
        if params.get("resultType") == "hits":
            return f'<FeatureCollection numberMatched="{self.total}"/>'
        at, size = int(params["startIndex"]), int(params["count"])
        if at % PAGE or size != PAGE:
            raise ValueError(f"asked for {size} features from {at} on")
        found = glob.glob(f"{self.folder}/page={at // PAGE}/*.txt")
        if not found:
            return '{"type":"FeatureCollection","features":[]}'
        with open(found[0], encoding="utf-8") as file:
            return file.read()


@register("read_feature_service", f"SELECT row_id, point_id, lon, lat, category, reading, date_trunc('milliseconds', ts) AS ts, active, value, "
                                  f"'{{\"k\":' || CAST(k::BIGINT AS VARCHAR) || '}}' AS nested FROM {POINTS} p")
def feature_service(spark, folder):
    """All points by way of a paged service: pages made of them are asked for in parallel, staged, checked and typed."""
    written = scratch_folder(spark)
    geojson_pages(spark, folder).select("page", F.col("payload").alias("value")).repartition("page").write.partitionBy("page").text(written)
    config = SourceConfig(id="pages", type="service", url="written pages", layer="obs", page_size=PAGE, max_parallel_requests=4)
    load = read_feature_service(spark, config, WrittenPages(written, points(spark, folder).df.count()))
    check_service_load(load)
    return load.table.df


@register("service_catalog", "SELECT 'obs:' || event_type AS name, CASE WHEN count(*) % 2 = 0 THEN 'Events of type ' || event_type ELSE 'obs:' || event_type END AS title, "
                             "CASE WHEN event_type = 'error' THEN 'csv' ELSE 'gml,application/json' END AS formats FROM events GROUP BY event_type")
def catalog(spark, folder):
    """Layers of a capabilities document with a layer for each type of event; one has formats of its own."""
    name = F.concat(F.lit("obs:"), F.col("event_type"))
    title = F.when(F.col("n") % 2 == 0, F.concat(F.lit("<Title> Events of type "), F.col("event_type"), F.lit("</Title>"))).otherwise(F.lit(""))
    formats = F.when(F.col("event_type") == "error", F.lit("<OutputFormats><Format>csv</Format></OutputFormats>")).otherwise(F.lit(""))
    layers = read(spark, folder, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).agg(F.array_join(F.collect_list(F.concat(
        F.lit("<FeatureType><Name>"), name, F.lit("</Name>"), title, formats, F.lit("</FeatureType>"))), "").alias("layers"))
    shared = ('<ows:OperationsMetadata><ows:Operation name="GetFeature"><ows:Parameter name="outputFormat"><ows:AllowedValues><ows:Value>gml</ows:Value>'
              "<ows:Value>application/json</ows:Value></ows:AllowedValues></ows:Parameter></ows:Operation></ows:OperationsMetadata>")
    head = '<WFS_Capabilities xmlns="http://www.opengis.net/wfs/2.0" xmlns:ows="http://www.opengis.net/ows/1.1">'
    document = layers.select(F.concat(F.lit(head + shared + "<FeatureTypeList>"), "layers", F.lit("</FeatureTypeList></WFS_Capabilities>")).alias("payload"))
    return service_catalog(document).select("name", "title", F.array_join("formats", ",").alias("formats"))


OBS = GmlLayout("obs", ("category", "reading", "ts", "active"), ("geom",))


@register("read_gml_pages", PAGES_SQL)
def gml(spark, folder):
    """Typed points of latitude-first GML pages with nil values and single MultiPoints."""
    return gml_points(read_gml_pages(gml_pages(spark, folder), OBS, "yx"), PAGE_FIELDS).df


@register("infer_gml_schema", "SELECT * FROM (VALUES ('category', 'string'), ('reading', 'string'), ('ts', 'date'), ('active', 'string')) t(name, kind) WHERE (SELECT count(*) FROM events) > 0")
def gml_schema(spark, folder):
    features = read_gml_pages(gml_pages(spark, folder), OBS, "yx")
    kinds = {f.name: f.kind for f in infer_gml_schema(features, OBS)}
    names = features.select(F.explode(F.map_keys("__properties")).alias("name")).distinct()
    return names.select("name", F.element_at(F.create_map(*[F.lit(v) for pair in kinds.items() for v in pair]), F.col("name")).alias("kind"))


@register("page_total", f"SELECT DISTINCT event_id // {PAGE} AS page, (event_id // {PAGE}) * 10 + 3 AS json_total, (event_id // {PAGE}) * 10 + 3 AS xml_total FROM events")
def page_totals(spark, folder):
    json = page_total(geojson_pages(spark, folder)).withColumnRenamed("total", "json_total")
    return json.join(page_total(gml_pages(spark, folder)).withColumnRenamed("total", "xml_total"), "page")


@register("resolve_role_predictions", "WITH c AS (SELECT c_custkey AS file, r.i AS ri, ['longitude', 'latitude', 'geometry'][r.i + 1] AS role, [NULL, 'x', 'y', 'z'][k.i + 1] AS col, "
                                      "((c_custkey * 31 + r.i * 17 + k.i * 53) % 101)::DOUBLE / 100.0::DOUBLE AS p FROM customer, range(3) r(i), range(4) k(i)), "
                                      "o AS (SELECT *, row_number() OVER w AS n, coalesce(lead(p) OVER w, 0) AS nxt FROM c WINDOW w AS (PARTITION BY file, role ORDER BY p DESC, col NULLS FIRST)), "
                                      "a AS (SELECT file, role, p AS probability, CASE WHEN p >= 0.55 AND p - nxt >= 0.10 THEN col END AS col FROM o WHERE n = 1) "
                                      "SELECT file, role, probability, CASE WHEN (SELECT count(*) FROM a b WHERE b.file = a.file AND b.col = a.col) = 1 THEN col END AS \"column\" FROM a")
def roles(spark, folder):
    """Candidate columns ranked per role; a column wanted twice goes to nobody."""
    base = read(spark, folder, "customer").select(F.col("c_custkey").alias("file"))
    role = F.explode(F.array(*[F.struct(F.lit(i).alias("ri"), F.lit(n).alias("role")) for i, n in enumerate(("longitude", "latitude", "geometry"))]))
    column = F.explode(F.array(*[F.struct(F.lit(i).alias("ki"), F.lit(n).cast("string").alias("column")) for i, n in enumerate((None, "x", "y", "z"))]))
    rows = base.select("file", role.alias("r")).select("file", "r.*", column.alias("k")).select("file", "ri", "role", "k.*")
    p = ((F.col("file") * 31 + F.col("ri") * 17 + F.col("ki") * 53) % 101).cast("double") / F.lit(100.0)
    return resolve_role_predictions(rows.withColumn("probability", p)).select("file", "role", "column", "probability")


# --- generated observations -----------------------------------------------

def _unit(n: str, name: str) -> tuple[str, str, str]:
    """Three small steps per hash keep the SQL readable for the parser."""
    return (f"((xor(({n}), ({n}) >> 16)::HUGEINT * {0x7feb352d}) % 4294967296)::BIGINT AS {name}1",
            f"((xor({name}1, {name}1 >> 15)::HUGEINT * {0x846ca68b}) % 4294967296)::BIGINT AS {name}2",
            f"xor({name}2, {name}2 >> 16)::DOUBLE / 4294967296.0::DOUBLE AS {name}")


_SEEDS = {"a": "i + 1", "b": "i + 123456789", "v": "i + 999", "t": "i + 424242", "q": "i + 88"}
_STEPS = [", ".join(_unit(n, k)[s] for k, n in _SEEDS.items()) for s in range(3)]


@register("generate_points", f"WITH n AS (SELECT l_orderkey * 8 + l_linenumber AS i FROM lineitem), s1 AS (SELECT i, {_STEPS[0]} FROM n), s2 AS (SELECT *, {_STEPS[1]} FROM s1), "
                             f"s3 AS (SELECT *, {_STEPS[2]} FROM s2) SELECT i AS row_id, 'points.' || i AS point_id, -8 + a * 10 AS lon, 50 + b * 9 AS lat, i::DOUBLE AS id, "
                             "['sensor', 'vehicle', 'station', 'event'][i % 4 + 1] AS category, ['active', 'inactive', 'warning'][i % 3 + 1] AS status, "
                             "floor(v * 10000 + 0.5) / 100.0::DOUBLE AS value, make_timestamp((1704067200000 + floor(t * 94694400000::DOUBLE)::BIGINT) * 1000) AS timestamp, "
                             "i % 3 <> 1 AS active, 'source-' || (i % 16) AS source, floor(q * 100 + 0.5)::DOUBLE AS quality FROM s3")
def generated(spark, folder):
    """One generated observation per order line, numbered by its key."""
    return observations(read(spark, folder, "lineitem"), F.col("l_orderkey") * 8 + F.col("l_linenumber"))


# --- checks ---------------------------------------------------------------

def _planted(spark, folder):
    """Points with repeated ids, missing ids and places off the globe."""
    table = points(spark, folder)
    n = F.col("row_id")
    id = F.when(n % 101 == 7, F.lit(None)).when(n % 500 == 3, F.lit("events.2")).otherwise(F.col("point_id"))
    lon = F.when(n % 211 == 9, F.lit(200.0)).when(n % 223 == 4, F.lit(None)).otherwise(F.col("lon"))
    return table.with_df(table.df.withColumn("point_id", id).withColumn("lon", lon))


PLANTED = (f"(SELECT * REPLACE (CASE WHEN row_id % 101 = 7 THEN NULL WHEN row_id % 500 = 3 THEN 'events.2' ELSE point_id END AS point_id, "
           f"CASE WHEN row_id % 211 = 9 THEN 200 WHEN row_id % 223 = 4 THEN NULL ELSE lon END AS lon) FROM {POINTS} p)")


@register("check_duplicate_ids", f"SELECT point_id AS id, count(*) AS count FROM {PLANTED} p WHERE point_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def repeated_ids(spark, folder):
    return duplicate_ids(_planted(spark, folder))


@register("check_coordinates", f"SELECT row_id FROM {PLANTED} p WHERE lon IS NULL OR abs(lon) > 180 OR abs(lat) > 90")
def wrong_places(spark, folder):
    return bad_coordinates(_planted(spark, folder)).select("row_id")


def _signed(spark, folder) -> DataFrame:
    """Pages of 500 rows in which every third page shows what the one before showed."""
    df = points(spark, folder).df
    page = F.floor(F.col("row_id") / 500).cast("bigint")
    shown = page - F.when(page % 3 == 2, F.lit(1)).otherwise(F.lit(0))
    return page_signatures(df.select(page.alias("page"), "row_id", (F.col("row_id") % 500).alias("n"), shown.alias("shown")), "page", "row_id", ["n", "shown"])


@register("check_repeated_page", "SELECT page FROM (SELECT DISTINCT event_id // 500 AS page FROM events) WHERE page % 3 = 2")
def same_pages(spark, folder):
    return repeated_pages(_signed(spark, folder), "page")


@register("check_page_overrun", "SELECT event_id // 500 AS page, count(*) AS features FROM events GROUP BY 1 HAVING count(*) > 499")
def overruns(spark, folder):
    return page_overruns(_signed(spark, folder), "page", 499)


@register("check_schema_drift", "SELECT DISTINCT 'extra-' || (event_id % 3) AS attribute FROM events WHERE event_id % 97 = 5")
def drift(spark, folder):
    df = points(spark, folder).df
    known = F.create_map(F.lit("category"), F.col("category"), F.lit("k"), F.col("k").cast("string"))
    extra = F.create_map(F.concat(F.lit("extra-"), (F.col("row_id") % 3).cast("string")), F.lit("?"))
    return schema_drift(df.select(F.when(F.col("row_id") % 97 == 5, F.map_concat(known, extra)).otherwise(known).alias("properties")), "properties", ["category", "k"])


@register("clamp_report", f"SELECT count(*) FILTER (abs(lat) > 85.05112878) AS clamped FROM {POINTS} p")
def clamped(spark, folder):
    return clamp_report(points(spark, folder))


@register("missing_id_warning", f"SELECT bool_or(point_id IS NULL) AS missing_ids FROM {PLANTED} p")
def missing_ids(spark, folder):
    return missing_id_warning(_planted(spark, folder))


@register("truncation_flag", "SELECT count(*) AS loaded, count(*) = 10000 AS truncated FROM events")
def truncated(spark, folder):
    return truncation_flag(points(spark, folder), 10000)


@register("dataset_bounds", f"SELECT min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM {POINTS} p")
def bounds(spark, folder):
    return dataset_bounds(points(spark, folder))


@register("dataset_bounds_union", f"SELECT min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM (SELECT lon, lat FROM {POINTS} p WHERE active UNION ALL SELECT lon, lat FROM {LINEITEM} l)")
def bounds_union(spark, folder):
    active = points(spark, folder)
    return union_bounds([dataset_bounds(active.with_df(active.df.where("active"))), dataset_bounds(lineitem(spark, folder))])


@register("load_report", f"SELECT count(*) AS loaded, FALSE AS truncated, count(*) FILTER (abs(lat) > 85.05112878) AS clamped, bool_or(point_id IS NULL) AS missing_ids, min(lon) AS west, min(lat) AS south, "
                         f"max(lon) AS east, max(lat) AS north FROM {PLANTED} p")
def report(spark, folder):
    """Every load count in one scan."""
    return load_report(_planted(spark, folder), 7)


# --- written tables, bundles and saved analyses ---------------------------

@register("write_points", f"SELECT row_id AS row FROM {PLACED} m WHERE x BETWEEN 0.1 AND 0.3 AND y BETWEEN 0.6 AND 0.8")
def written(spark, folder):
    """A table laid out by map cell and a rectangle that reads only the cells it touches."""
    table = write_points(points(spark, folder), scratch_folder(spark), 16)
    return pick_rectangle(table, 0.1, 0.6, 0.3, 0.8, cell_column="grid_cell")


@register("export_bundle", f"SELECT 'customers' AS source, count(*) AS rows, round(sum(c_acctbal), 2) AS total FROM customer UNION ALL SELECT 'events', count(*), round(sum(value), 2) FROM {POINTS} p")
def bundle(spark, folder):
    """Two tables through a backup and back."""
    path = scratch_folder(spark)
    export_bundle(spark, path, {"events": points(spark, folder), "customers": customer(spark, folder)})
    tables, _ = import_bundle(spark, path)
    parts = [tables[s].df.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(c), 2).alias("total")).select(F.lit(s).alias("source"), "rows", "total")
             for s, c in (("customers", "c_acctbal"), ("events", "value"))]
    return parts[0].unionByName(parts[1])


SPEC = AnalysisSpec(
    sources=(SourceConfig(id="events", name="events", type="csv", path="-", longitude_field="lon", latitude_field="lat", time_field="ts"),),
    analyses=(SourceAnalysis("events", (Field("category", "string"), Field("value", "number"), Field("ts", "date")), NESTED,
                             (SavedChart(ChartSpec("types", "bar", "category")), SavedChart(ChartSpec("values", "bar", "value", bins=12)),
                              SavedChart(ChartSpec("mean", "time", "ts", "reading", bins=10, aggregate="mean")))),),
    window=(1704844800000, 1706140800000), box={"west": -170, "east": 175, "south": -80, "north": 80})
SELECTED_SQL = (f"{NESTED_SQL} AND lon BETWEEN -170 AND 175 AND lat BETWEEN -80 AND 80 AND ts >= TIMESTAMP '2024-01-10' AND date_trunc('milliseconds', ts) <= TIMESTAMP '2024-01-25'")


@register("run_analysis", " UNION ALL ".join(f"SELECT * FROM ({q}) q{i}" for i, q in enumerate((
    categories_sql("types", POINTS, "category", SELECTED_SQL), histogram_sql("values", POINTS, "value", 12, where=SELECTED_SQL),
    histogram_sql("mean", POINTS, "(epoch_us(ts) // 1000)", 10, "date", where=SELECTED_SQL, measure="reading", aggregate="mean")))))
def saved_analysis(spark, folder):
    """A saved analysis through JSON and back, run with its filter, window and box."""
    spec = AnalysisSpec.from_json(SPEC.to_json())
    run = run_tables(spec, {"events": points(spark, folder)})
    return run.results["events"].withColumn("value", F.round("value", 4))


# --- saved analyses from CSV files to charts and reports ------------------

def _run_from_csv(spark, folder) -> AnalysisRun:
    """Events, some without a usable longitude, and customers as CSV files, loaded and charted by a saved analysis."""
    n = F.col("row_id")
    events = points(spark, folder).df.select(
        F.when(n % 31 == 3, F.lit("nowhere")).otherwise(F.col("lon").cast("string")).alias("lon"), "lat", n.alias("event_id"), "category", "value", "reading", "k",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"))
    customers = customer(spark, folder).df.select("lon", "lat", "c_custkey", "c_acctbal", "c_nationkey")
    placed = dict(type="csv", longitude_field="lon", latitude_field="lat")
    spec = AnalysisSpec(
        sources=(SourceConfig(id="events", name="events", path=write_text(spark, events), time_field="ts", major_field="reading", minor_field="k",
                              orientation_field="value", major_unit="nm", **placed),
                 SourceConfig(id="customers", name="customers", path=write_text(spark, customers), **placed)),
        analyses=(SourceAnalysis("events", (Field("category", "string"), Field("value", "number"), Field("ts", "date")), NESTED,
                                 (SavedChart(ChartSpec("plot", "scatter", "reading", "ts", binned=False)),
                                  SavedChart(ChartSpec("pairs", "scatter", "value", "k", binned=False), (SeriesMap("customers", "c_acctbal", "c_nationkey"),)),
                                  SavedChart(ChartSpec("both", "bar", "value", bins=12), (SeriesMap("customers", "c_acctbal"),)))),
                  SourceAnalysis("customers", (Field("c_nationkey", "number"),), rule("c_nationkey", "lt", 10), (SavedChart(ChartSpec("nations", "bar", "c_nationkey", bins=5)),))))
    return run_analysis(spark, AnalysisSpec.from_json(spec.to_json()), scratch_folder(spark))


GOOD = f"(SELECT *, (epoch_us(ts) // 1000) AS ms FROM {POINTS} p WHERE row_id % 31 <> 3)"
_COUNTED = ("count(*) AS loaded, FALSE AS truncated, count(*) FILTER (abs(lat) > 85.05112878) AS clamped, FALSE AS missing_ids, min(lon) AS west, min(lat) AS south, "
            "max(lon) AS east, max(lat) AS north")


@register("run_analysis_report",
          f"SELECT 'events' AS source, (SELECT count(*) FROM events) AS total, count(*) AS imported, (SELECT count(*) FROM events) - count(*) AS rejected, 0::BIGINT AS filtered, "
          f"{_COUNTED}, count(*) FILTER (NOT coalesce({VALID}, FALSE)) AS invalid_ellipses FROM (SELECT lon, lat, reading * 1852 AS a, k AS b, value AS t FROM {GOOD} g) e "
          f"UNION ALL SELECT 'customers', count(*), count(*), 0::BIGINT, 0::BIGINT, {_COUNTED}, NULL FROM {CUSTOMER} c")
def analysis_reports(spark, folder):
    """What each source's load accepted, rejected and left out, its bounds, and its rows without an ellipse."""
    run = _run_from_csv(spark, folder)
    parts = []
    for source, report in run.reports.items():
        totals = [F.lit(run.imports[source].totals[k]).cast("bigint").alias(k) for k in ("total", "imported", "rejected", "filtered")]
        parts.append(report.select(F.lit(source).alias("source"), *totals, "*"))
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


@register("run_analysis_raw", f"WITH d AS (SELECT min(reading) AS x0, max(reading) AS x1, min(ms) AS y0, max(ms) AS y1 FROM {GOOD} g) "
                              "SELECT row_id::DOUBLE AS event_id, round((reading - x0) / (x1 - x0) * 2 - 1, 6) AS x, round((ms - y0) / (y1 - y0) * 2 - 1, 6) AS y "
                              f"FROM {GOOD} g, d WHERE reading IS NOT NULL AND {NESTED_SQL}")
def analysis_raw(spark, folder):
    """Every selected observation that has a place in the unbinned chart, from its CSV cell on."""
    run = _run_from_csv(spark, folder)
    table = run.tables["events"]
    known = table.df.select(table.col(table.row).alias("known"), "event_id")
    return run.charts["events", "plot"].join(known, F.col("row") == F.col("known")).select("event_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_SHARES = ", ".join(f"round({f}(({c} - {c}0) / ({c}1 - {c}0)) FILTER (x IS NOT NULL AND y IS NOT NULL), 6) AS {c}{i}_" for i, f in enumerate(("min", "max")) for c in ("x", "y"))


def _plots_sql(chart: str, every: str, chosen: str) -> str:
    """Counts and extent per source of the chosen pairs, within the bounds of all."""
    names = ", ".join(f"{c}{i}_ AS {c}{i}" for c in ("x", "y") for i in (0, 1))
    return (f"SELECT chart_id, source_id, selected, plotted, missing, {names} FROM ("
            f"WITH d AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {every} e) "
            f"SELECT '{chart}' AS chart_id, source_id, count(*) AS selected, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS plotted, "
            f"count(*) FILTER (x IS NULL OR y IS NULL) AS missing, {_SHARES} FROM {chosen} c, d GROUP BY source_id)")


_PAIRS = (f"SELECT 'events' AS source_id, value AS x, k AS y FROM {GOOD} g", "SELECT 'customers', c_acctbal::DOUBLE, c_nationkey::DOUBLE FROM customer")


@register("run_analysis_plots", " UNION ALL ".join((
    _plots_sql("plot", f"(SELECT reading AS x, ms AS y FROM {GOOD} g)", f"(SELECT 'events' AS source_id, reading AS x, ms AS y FROM {GOOD} g WHERE {NESTED_SQL})"),
    _plots_sql("pairs", f"({_PAIRS[0]} UNION ALL {_PAIRS[1]})", f"({_PAIRS[0]} WHERE {NESTED_SQL} UNION ALL {_PAIRS[1]} WHERE c_nationkey < 10)"))))
def analysis_plots(spark, folder):
    """Selected, plotted and missing rows and the occupied part of every unbinned chart."""
    run = _run_from_csv(spark, folder)
    parts = [run.plots["events", c].select(F.lit(c).alias("chart_id"), "source_id", "selected", "plotted", "missing", *[F.round(s, 6).alias(s) for s in ("x0", "x1", "y0", "y1")])
             for c in ("plot", "pairs")]
    return parts[0].unionByName(parts[1])


_BALANCES = (f"SELECT 'events' AS source_id, value AS v FROM {GOOD} g", "SELECT 'customers', c_acctbal::DOUBLE FROM customer")


@register("run_analysis_compare",
          f"WITH bins AS {edges_sql(f'({_BALANCES[0]} UNION ALL {_BALANCES[1]})', 'v', 12)}, s AS ({_BALANCES[0]} WHERE {NESTED_SQL} UNION ALL {_BALANCES[1]} WHERE c_nationkey < 10), "
          f"n AS (SELECT 'events' AS source_id UNION ALL SELECT 'customers' UNION ALL SELECT NULL), c AS (SELECT s.source_id, b.i FROM s JOIN bins b ON {inside('v')}) "
          "SELECT n.source_id, 'both' AS chart_id, b.i AS cell, b.i AS x_bin, 0::BIGINT AS y_bin, "
          "(SELECT count(*) FROM c WHERE c.i = b.i AND (n.source_id IS NULL OR c.source_id = n.source_id)) AS count, NULL::DOUBLE AS value FROM n CROSS JOIN bins b "
          "UNION ALL SELECT n.source_id, 'both', -1, NULL, NULL, (SELECT count(*) FROM s WHERE v IS NULL AND (n.source_id IS NULL OR s.source_id = n.source_id)), NULL FROM n")
def analysis_compare(spark, folder):
    """Two loaded sources, each under its own filter, on shared bins."""
    return _run_from_csv(spark, folder).charts["events", "both"]
