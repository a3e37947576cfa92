"""A paged feature service as a Spark data source.

Offsets are planned as ranges, one per Spark partition, and each range is pulled page
by page; the answers are rows of text that Spark decodes. How a request is answered is
a function handed in: a live service, or a folder of saved answers.
"""

from __future__ import annotations

import hashlib
import json
import re
import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.values import iso_from_millis
from ..operators.expressions import load_rule_literal, validate_load_rules
from ..operators.integrity import (LoadError, check_coordinates, check_duplicate_ids, check_page_overrun, check_repeated_page,
                                   check_schema_drift, page_signatures)
from ..session import require_utc, scratch_folder
from ..table import BOOLEAN, DATE, NUMBER, STRING, Field, PointTable
from .bounds import LoadBounds
from .config import SourceConfig
from .pages import (GmlLayout, geojson_points, gml_attributes, gml_layout, gml_points, infer_gml_schema, infer_json_schema,
                    raise_service_error, read_geojson_pages, read_gml_pages)

Fetch = Callable[[Mapping[str, str]], str]

# Names of the filter language and of the request parameters.
COMPARISONS = {"eq": "PropertyIsEqualTo", "ne": "PropertyIsNotEqualTo", "gt": "PropertyIsGreaterThan",
               "gte": "PropertyIsGreaterThanOrEqualTo", "lt": "PropertyIsLessThan", "lte": "PropertyIsLessThanOrEqualTo"}
FILTER_NS = {"fes": "http://www.opengis.net/fes/2.0", "ogc": "http://www.opengis.net/ogc"}
GML_NS = {"fes": "http://www.opengis.net/gml/3.2", "ogc": "http://www.opengis.net/gml"}
CRS84 = "urn:ogc:def:crs:OGC:1.3:CRS84"

#: Pages a range asks for in a wave whose end is not known.
WAVE_PAGES = 8
#: Pages are long texts, and a reader holds up to 4,096 rows of a row group at once: groups are cut at a few megabytes, page by page.
PAGE_OPTIONS = {"parquet.block.size": str(4 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


# --- requests -------------------------------------------------------------

def service_url(base: str, version: str, operation: str, params: Mapping[str, str] | None = None) -> str:
    """Request address; other query arguments of the base, such as tokens, stay."""
    values = {"service": "WFS", "version": version, "request": operation, **(params or {})}
    parts = urllib.parse.urlsplit(base)
    replaced = {k.lower() for k in values}
    kept = [(k, v) for k, v in urllib.parse.parse_qsl(parts.query, keep_blank_values=True) if k.lower() not in replaced]
    return urllib.parse.urlunsplit(parts._replace(query=urllib.parse.urlencode([*kept, *values.items()])))


def http_fetch(base: str, timeout: float = 45.0) -> Fetch:
    """Answer requests from a live service."""
    def fetch(params: Mapping[str, str]) -> str:
        rest = {k: v for k, v in params.items() if k not in ("version", "request")}
        with urllib.request.urlopen(service_url(base, params["version"], params["request"], rest), timeout=timeout) as answer:
            return answer.read().decode("utf-8")
    return fetch


@dataclass(frozen=True)
class QueryFields:
    """How the service itself names the time, the geometry and the attributes."""

    time: str = ""
    geometry: str = ""
    namespaces: Mapping[str, str] = field(default_factory=dict)
    attributes: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class _Words:
    """The filter vocabulary of one protocol version, as elements."""

    prefix: str
    old: bool

    def element(self, name: str, *inside: ET.Element, text: str | None = None, **attributes: str) -> ET.Element:
        made = ET.Element(f"{self.prefix}:{name}", attributes)
        made.text = text
        made.extend(inside)
        return made

    def name(self, text: str) -> ET.Element:
        return self.element("ValueReference" if self.prefix == "fes" else "PropertyName", text=text)

    def compare(self, op: str, name: str, value: str) -> ET.Element:
        return self.element(COMPARISONS[op], self.name(name), self.element("Literal", text=value))

    def rule(self, rule: Mapping, name: str) -> ET.Element:
        op = rule["op"]
        if op in ("null", "notnull"):
            missing = self.element("PropertyIsNull", self.name(name))
            return missing if op == "null" else self.element("Not", missing)
        value = load_rule_literal(rule)
        if op != "contains":
            return self.compare(op, name, value)
        # Every character with a meaning in the pattern is escaped; the text may stand anywhere.
        pattern = "*" + "".join(f"!{c}" if c in "!*?" else c for c in value) + "*"
        how = {"wildCard": "*", "singleChar": "?", "escape" if self.old else "escapeChar": "!", "matchCase": "true"}
        return self.element("PropertyIsLike", self.name(name), self.element("Literal", text=pattern), **how)

    def box(self, name: str, box: Sequence[float]) -> ET.Element:
        corners = [" ".join(f"{v:.15g}" for v in box[i:i + 2]) for i in (0, 2)]
        if self.old:
            area = ET.Element("gml:Box", srsName="EPSG:4326")
            ET.SubElement(area, "gml:coordinates").text = " ".join(c.replace(" ", ",") for c in corners)
        else:
            area = ET.Element("gml:Envelope", srsName=CRS84)
            for tag, corner in zip(("gml:lowerCorner", "gml:upperCorner"), corners):
                ET.SubElement(area, tag).text = corner
        return self.element("BBOX", self.name(name), area)


def push_service_filter(version: str, bounds: LoadBounds, names: QueryFields, rules: Sequence[Mapping] = ()) -> str | None:
    """Load rules, time range and box as one filter document for the service, or None."""
    words = _Words("fes" if version == "2.0.0" else "ogc", version == "1.0.0")
    bounds.check()
    if bounds.time and not names.time:
        raise LoadError("A time range needs a time attribute: set time_field or load all times")
    if bounds.box and not names.geometry:
        raise LoadError("A box needs a geometry attribute: set geometry_field")
    tests = [words.rule(r, names.attributes.get(r["field"], r["field"])) for r in validate_load_rules(rules)]
    if bounds.time:
        first, last = map(iso_from_millis, bounds.millis())
        tests += [words.compare("gte", names.time, first), words.compare("lte", names.time, last)]
    if bounds.box:
        tests.append(words.box(names.geometry, bounds.box))
    if not tests:
        return None
    own = {words.prefix: FILTER_NS[words.prefix], "gml": GML_NS[words.prefix]}
    usable = {k: v for k, v in names.namespaces.items() if k not in {*FILTER_NS, "gml", "xml", "xmlns"} and re.fullmatch(r"[^\W\d][\w.-]*", k, re.ASCII)}
    spaces = {f"xmlns:{k}": v for k, v in {**own, **usable}.items()}
    body = tests if len(tests) == 1 else [words.element("And", *tests)]
    return ET.tostring(words.element("Filter", *body, **spaces), encoding="unicode")


# --- schema and catalog ---------------------------------------------------

def _local(name: str) -> str:
    return re.split("[}:]", name)[-1]


def schema_kind(xsd_type: str) -> str:
    """Kind of a declared XML type; every numeric type is one kind."""
    lower = xsd_type.lower()
    for kind, words in ((DATE, ("date", "time")), (BOOLEAN, ("bool",)),
                        (NUMBER, ("int", "float", "double", "decimal", "long", "short", "byte"))):
        if any(w in lower for w in words):
            return kind
    return STRING


def service_schema(xsd: str, config: SourceConfig) -> tuple[list[Field], QueryFields, GmlLayout]:
    """Declared attributes of one feature type and how the service refers to them.

    A time or geometry attribute is chosen only when it is the single candidate.
    """
    root = ET.fromstring(xsd)
    raise_service_error(root)
    namespaces = dict(re.findall(r'xmlns:([\w.-]+)\s*=\s*["\']([^"\']*)["\']', xsd))
    layer = _local(config.layer)
    types = [_local(e.get("type", "")) for e in root if _local(e.tag) == "element" and e.get("name") == layer]
    scope = next((e for e in root.iter() if _local(e.tag) == "complexType" and types and e.get("name") == types[0]), root)
    elements = [e for s in scope.iter() if _local(s.tag) == "sequence" for e in s if _local(e.tag) == "element" and e.get("name")]

    def is_geometry(e: ET.Element) -> bool:
        declared = e.get("type", "")
        return declared.split(":")[0] == "gml" or bool(
            re.search("geometry|point|polygon|curve|surface|line|location", declared, re.I))

    fields = [Field(e.get("name"), schema_kind(e.get("type", "string"))) for e in elements if not is_geometry(e)]
    places = [e.get("name") for e in elements if is_geometry(e)]
    dates = [f.name for f in fields if f.kind == DATE]
    prefix = next((k for k, v in namespaces.items() if v == root.get("targetNamespace")), None)
    qualified = prefix and root.get("elementFormDefault") == "qualified"
    refer = lambda name: f"{prefix}:{name}" if qualified else name
    names = QueryFields(config.time_field or (refer(dates[0]) if len(dates) == 1 else ""),
                        config.geometry_field or (refer(places[0]) if len(places) == 1 else ""),
                        namespaces, {f.name: refer(f.name) for f in fields})
    return fields, names, GmlLayout(layer, tuple(f.name for f in fields), tuple(places))


def service_catalog(capabilities: DataFrame) -> DataFrame:
    """Layers of capability documents (``payload``): ``name, title, formats``.

    Formats listed by a layer come before those the service lists for all layers.
    """
    named = "struct<Name: string, Title: string, OutputFormats: struct<Format: array<string>>>"
    parameter = "struct<_name: string, Value: array<string>, AllowedValues: struct<Value: array<string>>>"
    schema = (f"FeatureTypeList struct<FeatureType: array<{named}>>, OperationsMetadata struct<Parameter: array<{parameter}>, "
              f"Operation: array<struct<_name: string, Parameter: array<{parameter}>>>>")
    doc = capabilities.select(F.from_xml("payload", schema, {"ignoreNamespace": "true"}).alias("d"))
    empty = F.array().cast("array<string>")
    values = lambda parameters: F.flatten(F.transform(
        F.filter(parameters, lambda p: p["_name"] == "outputFormat"),
        lambda p: F.concat(F.coalesce(p["Value"], empty), F.coalesce(p["AllowedValues"]["Value"], empty))))
    operations = F.filter("d.OperationsMetadata.Operation", lambda o: o["_name"] == "GetFeature")
    shared = F.concat(F.coalesce(values(F.col("d.OperationsMetadata.Parameter")), empty),
                      F.coalesce(F.flatten(F.transform(operations, lambda o: F.coalesce(values(o["Parameter"]), empty))), empty))
    return (doc.select(F.explode("d.FeatureTypeList.FeatureType").alias("t"), shared.alias("shared"))
            .where(F.length(F.trim("t.Name")) > 0)
            .select(F.trim("t.Name").alias("name"),
                    F.when(F.coalesce(F.trim("t.Title"), F.lit("")).isin(""), F.trim("t.Name")).otherwise(F.trim("t.Title")).alias("title"),
                    F.when(F.size(F.coalesce("t.OutputFormats.Format", empty)) > 0, F.col("t.OutputFormats.Format"))
                    .otherwise(F.col("shared")).alias("formats")))


# --- paging ---------------------------------------------------------------

class PageRange(NamedTuple):
    """Offsets from ``start`` up to, but not including, ``end``."""

    start: int
    end: int


@dataclass(frozen=True)
class PagedRequest:
    """Everything needed to ask for any page."""

    version: str
    layer: str
    srs: str
    format: str
    sort: str
    filter: str | None
    page_size: int
    limit: int | None
    stop_on_short: bool

    @classmethod
    def of(cls, config: SourceConfig, filter: str | None) -> "PagedRequest":
        return cls(config.version, config.layer, config.srs, config.format, config.sort, filter, config.page_size,
                   config.limit, config.paging_end == "short")

    def params(self, **extra: str) -> dict[str, str]:
        out = {"version": self.version, "request": "GetFeature",
               "typeNames" if self.version == "2.0.0" else "typeName": self.layer, "srsName": self.srs, **extra}
        if self.filter:
            out["filter"] = self.filter
        if self.sort:
            out["sortBy"] = f"{self.sort} A"
        return out

    def page(self, fetch: Fetch, offset: int, count: int) -> tuple[str, int, str]:
        """The answer for one page, how many features it holds, and their signature."""
        size = "count" if self.version == "2.0.0" else "maxFeatures"
        text = fetch(self.params(outputFormat=self.format, startIndex=str(offset), **{size: str(count)}))
        return text, *describe_page(text)

    def hits(self, fetch: Fetch) -> int | None:
        """The advertised total; older services have none that can be trusted."""
        if self.version == "1.0.0":
            return None
        try:
            root = ET.fromstring(fetch(self.params(resultType="hits")))
            raise_service_error(root)
            return int(root.get("numberMatched") or root.get("numberOfFeatures"))
        except Exception:
            return None  # totals are advisory, so a service without them is no error


def describe_page(text: str) -> tuple[int, str]:
    """How many features a page holds, and a digest of its first and last one; what else the page says may differ."""
    if text.lstrip().startswith("{"):
        features = json.loads(text).get("features") or []
        ends = [json.dumps(f, sort_keys=True) for f in (features[:1] + features[-1:])]
    else:
        root = ET.fromstring(text)
        raise_service_error(root)
        features = [f for m in root if _local(m.tag) in ("member", "featureMember", "featureMembers") for f in m]
        ends = [ET.tostring(f, encoding="unicode").strip() for f in (features[:1] + features[-1:])]
    return len(features), hashlib.sha256("\n".join(ends).encode()).hexdigest() if features else ""


def plan_ranges(start: int, total: int | None, page_size: int, limit: int | None, parts: int) -> list[PageRange]:
    """One wave of ranges in whole pages: up to the advertised total, else a few pages for each part.

    Totals only shape the plan. Past the total a single range looks for more.
    """
    if total is None:
        pages = parts * WAVE_PAGES
    elif total > start:
        pages = -(-(total - start) // page_size)
    else:
        pages, parts = WAVE_PAGES, 1
    end = start + pages * page_size if limit is None else min(limit, start + pages * page_size)
    step = -(-pages // parts) * page_size
    return [PageRange(s, min(s + step, end)) for s in range(start, end, step)]


def read_range(fetch: Fetch, request: PagedRequest, span: PageRange, before: str = "") -> Iterator[tuple[int, int, int, str, str]]:
    """Pages of one range as ``(offset, requested, features, text, signature)``.

    A service may return fewer features than asked, so each request starts where the
    last answer really ended. The page that ends the data ends the range: an empty one,
    which is kept as a row without features, or on request a short one. So does a page
    with the signature of the one before it (``before`` is that of the page in front of
    the range): a service that ignores offsets would give it for ever.
    """
    at = span.start
    while at < span.end:
        wanted = min(request.page_size, span.end - at)
        text, count, signature = request.page(fetch, at, wanted)
        if count > wanted:
            raise LoadError(f"A page of {count} features was sent for a request of {wanted}")
        yield at, wanted, count, text, signature
        at += count
        if count == 0 or signature == before or request.stop_on_short and count < wanted:
            return
        before = signature


class _Span(InputPartition):
    def __init__(self, span: PageRange):
        self.span = span


PAGE_ROWS = "page bigint, requested int, features int, payload string, signature string"
PAGE_BATCH = pa.schema([("page", pa.int64()), ("requested", pa.int32()), ("features", pa.int32()), ("payload", pa.string()), ("signature", pa.string())])


def page_batch(row: tuple[int, int, int, str, str]) -> pa.RecordBatch:
    """One page as a batch of its own; of plain rows a worker gathers thousands before it hands them over."""
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, PAGE_BATCH)], schema=PAGE_BATCH)


def service_source(fetch: Fetch, request: PagedRequest, spans: Sequence[PageRange], before: str = "") -> type[DataSource]:
    """A data source class whose rows are pages; ``before`` is the signature of the page in front of the first range."""

    class Reader(DataSourceReader):
        def partitions(self):
            return [_Span(s) for s in spans]

        def read(self, partition):
            yield from map(page_batch, read_range(fetch, request, partition.span, before if partition.span == spans[0] else ""))

    class Pages(DataSource):
        @classmethod
        def name(cls):
            return "feature_service_pages"

        def schema(self):
            return PAGE_ROWS

        def reader(self, schema):
            return Reader()

    return Pages


def chained_repeats(pages: DataFrame) -> DataFrame:
    """Offsets of pages that begin where another one with the same signature ends."""
    ends = pages.where("features > 0").select((F.col("page") + F.col("features")).alias("next"), F.col("signature").alias("before"))
    return pages.join(ends, (F.col("page") == F.col("next")) & (F.col("signature") == F.col("before"))).select("page")


def stage_pages(spark: SparkSession, fetch: Fetch, request: PagedRequest, first: tuple[str, int, str], parts: int, folder: str) -> DataFrame:
    """Write every page once, in waves of parallel ranges, and read back one contiguous run of them.

    ``first`` is the answer at offset zero, which is not asked for again. A service that
    gives fewer features than asked is asked for as many as it gives. Pages behind the
    first page that ends the data are left out, whichever range they came from. Pages are
    compared with the ones before them as waves arrive, so a service that repeats a page
    fails the load before the next wave is planned.
    """
    text, count, before = first
    wanted = min(request.page_size, request.limit or request.page_size)
    spark.createDataFrame([(0, wanted, count, text, before)], PAGE_ROWS).write.options(**PAGE_OPTIONS).parquet(folder)
    ended = count == 0 or request.stop_on_short and count < wanted
    total = None if ended else request.hits(fetch)
    if 0 < count < wanted:
        request = replace(request, page_size=count)
    at, end = count, count if ended else None
    while end is None and (request.limit is None or at < request.limit):
        spans = plan_ranges(at, total, request.page_size, request.limit, parts)
        spark.dataSource.register(service_source(fetch, request, spans, before))
        spark.read.format("feature_service_pages").load().write.mode("append").options(**PAGE_OPTIONS).parquet(folder)
        arrived = spark.read.schema(PAGE_ROWS).parquet(folder)
        repeated = chained_repeats(arrived.where((F.col("page") >= at) | (F.col("page") + F.col("features") == at))).agg(F.min("page")).first()[0]
        if repeated is not None:
            raise LoadError(f"Page {repeated} repeats the one before it; offsets are not supported")
        # One number: where the first page that ends the data leaves off.
        last = F.col("features") == 0
        if request.stop_on_short:
            last |= F.col("features") < F.col("requested")
        end = arrived.where(last & (F.col("page") >= at)).agg(F.min(F.col("page") + F.col("features"))).first()[0]
        at = spans[-1].end
        ahead = arrived.where(F.col("page") + F.col("features") == at).select("signature").first()
        before = ahead[0] if ahead else ""
    pages = spark.read.schema(PAGE_ROWS).parquet(folder).where("features > 0")
    return pages if end is None else pages.where(F.col("page") < end)


@dataclass(frozen=True)
class ServiceLoad:
    """Staged pages, the features on them and the typed points made of these."""

    pages: DataFrame
    features: DataFrame
    table: PointTable
    limit: int | None


def read_feature_service(spark: SparkSession, config: SourceConfig, fetch: Fetch, bounds: LoadBounds | None = None,
                         described: str | None = None, folder: str | None = None) -> ServiceLoad:
    """Points of a service, restricted on the server. ``described`` is its schema document.

    The service is asked once: its answers are staged in ``folder`` (a new shared one by
    default), and everything is decoded from there. An attribute that neither the schema
    nor the first page has fails the load.
    """
    config.check()
    require_utc(spark)
    bounds = bounds or LoadBounds()
    hints, names, layout = service_schema(described, config) if described else (
        [], QueryFields(config.time_field, config.geometry_field), None)
    validate_load_rules(config.load_rules, hints or None)
    request = PagedRequest.of(config, push_service_filter(config.version, bounds, names, config.load_rules))
    wanted = min(config.page_size, config.limit or config.page_size)
    first, count, signature = request.page(fetch, 0, wanted)
    if count > wanted:
        raise LoadError(f"A page of {count} features was sent for a request of {wanted}")
    staged = stage_pages(spark, fetch, request, (first, count, signature), config.max_parallel_requests, folder or scratch_folder(spark))
    pages = staged.select("page", "payload")
    time = names.time.split(":")[-1]
    # The first page settles the schema; offsets become row ids.
    sample = spark.createDataFrame([(0, first)], "page bigint, payload string")
    if first.lstrip().startswith("{"):
        fields = infer_json_schema(read_geojson_pages(sample), hints)
        features = read_geojson_pages(pages)
        check_schema_drift(features, "__properties", [f.name for f in fields])
        table = geojson_points(_by_offset(features), fields, config.name, time)
    else:
        layout = layout or gml_layout(first) or GmlLayout(_local(config.layer), (), ())
        check_schema_drift(gml_attributes(pages), "attributes", [*layout.attributes, *layout.geometries])
        fields = infer_gml_schema(read_gml_pages(sample, layout, config.axis), layout, hints)
        features = read_gml_pages(pages, layout, config.axis)
        table = gml_points(_by_offset(features), fields, config.name, time)
    return ServiceLoad(staged, features, table, config.limit)


def _by_offset(features: DataFrame) -> DataFrame:
    """Page offsets plus the place on the page are row ids already."""
    return features.withColumn("__ordinal", F.col("__page") + F.col("__ordinal")).withColumn("__page", F.lit(0).cast("bigint"))


def check_service_load(load: ServiceLoad) -> None:
    """Fail a load that overlaps, repeats pages or leaves the globe. Pages are compared by their features, as they were while loading."""
    check_page_overrun(load.pages, "page", "requested")
    check_repeated_page(page_signatures(load.features, "__page", "__ordinal", ["__id", "__lon", "__lat", "__properties"]), "__page")
    check_duplicate_ids(load.table)
    check_coordinates(load.table)
