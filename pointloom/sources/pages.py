"""Pages of a feature service: GeoJSON and GML text to typed points.

A page is one row of text, so pages decode in parallel with Spark's own JSON, variant
and XML functions. Files of saved pages and a live service share this code.

Decoded features are rows of ``__page, __ordinal, __id, __lon, __lat, __properties``;
the underscores keep them apart from attributes of the same name.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.values import is_blank, parse_utc, to_flag, to_number, trimmed
from ..session import hint_if_small
from ..table import BOOLEAN, DATE, NUMBER, STRING, Field, PointTable, quote, unique_name

PAGE_SHIFT = 31  # the place on a page is a 32-bit number, so it always fits below this bit

FEATURES = ("array<struct<id: variant, geometry: struct<type: string, coordinates: variant>, "
            "properties: map<string, variant>>>")
COLLECTION = f"type string, numberMatched variant, totalFeatures variant, features {FEATURES}"
NUMBER_SHAPE = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"


def saved_pages(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Saved responses as ``page, payload``; pages are numbered in file-name order."""
    paths = path if isinstance(path, str) else list(path)
    text = (spark.read.option("wholetext", True).text(paths)
            .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("payload")))
    # One small row per page: numbering lists the files and reads none of them.
    names = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("file"))
    numbered = names.withColumn("page", (F.row_number().over(Window.orderBy("file")) - 1).cast("bigint"))
    return text.join(hint_if_small(numbered, len(text.inputFiles())), "file").select("page", "payload")


def _whole_number(text: Column) -> Column:
    n = text.try_cast("double")
    return F.when((n >= 0) & (n == F.floor(n)) & (n <= 9007199254740991), n.cast("bigint"))


def page_total(pages: DataFrame) -> DataFrame:
    """Advisory totals per page; never a reason to stop reading."""
    doc = F.from_json("payload", "numberMatched variant, totalFeatures variant")
    in_json = F.coalesce(doc["numberMatched"].cast("string"), doc["totalFeatures"].cast("string"))
    is_json = F.rlike("payload", F.lit(r"^\s*\{"))
    in_xml = F.from_xml(F.when(~is_json, F.col("payload")), "_numberMatched string", {"ignoreNamespace": "true"})["_numberMatched"]
    total = F.when(is_json, in_json).otherwise(in_xml)
    return pages.select("page", _whole_number(total).alias("total"))


# --- GeoJSON --------------------------------------------------------------

def read_geojson_pages(pages: DataFrame) -> DataFrame:
    """Features of GeoJSON pages.

    Coordinates are always longitude, latitude. A MultiPoint with one member is that
    point; more members fail the load, because one row is one location.
    """
    doc = F.from_json("payload", COLLECTION, {"mode": "FAILFAST"})
    parsed = pages.select("page", doc.alias("d"))
    listed = F.when((F.col("d.type") == "FeatureCollection") & F.col("d.features").isNotNull(), F.col("d.features"))
    listed = listed.otherwise(F.raise_error(F.lit("Expected a GeoJSON FeatureCollection")).cast(FEATURES))
    rows = parsed.select("page", listed.alias("features")).select("page", F.posexplode("features").alias("ordinal", "f"))

    kind, place = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    members = F.coalesce(F.size(F.try_variant_get(place, "$", "array<variant>")), F.lit(0))
    problem = (F.when((kind == "MultiPoint") & (members != 1), F.lit("Only single-point MultiPoint features are supported"))
               .when(F.coalesce(~kind.isin("Point", "MultiPoint"), F.lit(True)), F.lit("Only Point geometries are supported")))

    def coordinate(i: int) -> Column:
        single = F.try_variant_get(place, f"$[0][{i}]", "double")
        return (F.when(problem.isNotNull(), F.raise_error(problem).cast("double"))
                .when(kind == "MultiPoint", single).otherwise(F.try_variant_get(place, f"$[{i}]", "double")))

    return rows.select(F.col("page").alias("__page"), F.col("ordinal").alias("__ordinal"),
                       F.col("f.id").cast("string").alias("__id"), coordinate(0).alias("__lon"),
                       coordinate(1).alias("__lat"), F.col("f.properties").alias("__properties"))


def infer_json_schema(features: DataFrame, hints: Sequence[Field] = ()) -> list[Field]:
    """Kind of every property: hints first, then its first filled value, else text."""
    shape, text = F.schema_of_variant("value"), F.col("value").cast("string")
    kind = (F.when(F.rlike(shape, F.lit(NUMBER_SHAPE)), F.lit(NUMBER)).when(shape == "BOOLEAN", F.lit(BOOLEAN))
            .when((shape == "STRING") & parse_utc(text).isNotNull(), F.lit(DATE))
            .when(shape != "VOID", F.lit(STRING)))
    at = F.struct("__page", "__ordinal")
    found = (features.select("__page", "__ordinal", F.explode("__properties").alias("key", "value"))
             .select("key", at.alias("at"), kind.alias("kind")).groupBy("key")
             .agg(F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("at"))).alias("kind"), F.min("at").alias("first"))
             .orderBy("first", "key").collect())  # one row per attribute
    known = {f.name for f in hints}
    return [*hints, *[Field(r["key"], r["kind"] or STRING) for r in found if r["key"] not in known]]


def geojson_points(features: DataFrame, fields: Sequence[Field], name: str = "Dataset", time_field: str = "") -> PointTable:
    """Typed points of decoded GeoJSON features."""
    values = [F.try_element_at("__properties", F.lit(f.name)).cast("string") for f in fields]
    return _points(features, values, fields, name, time_field)


# --- GML ------------------------------------------------------------------

@dataclass(frozen=True)
class GmlLayout:
    """Element names of one feature type: needed to read its XML into columns."""

    feature: str
    attributes: tuple[str, ...]
    geometries: tuple[str, ...]

    @property
    def schema(self) -> str:
        point = "struct<pos: struct<_VALUE: string>, coordinates: struct<_VALUE: string>>"
        place = (f"struct<Point: {point}, MultiPoint: struct<pointMember: array<struct<Point: {point}>>, "
                 f"pointMembers: array<struct<Point: array<{point}>>>>>")
        parts = ["_id: string", "_fid: string", *[f"{quote(g)}: {place}" for g in self.geometries],
                 *[f"{quote(a)}: struct<_nil: string, _VALUE: string>" for a in self.attributes]]
        feature = f"struct<{', '.join(parts)}>"
        one = f"{quote(self.feature)}: {feature}"
        return (f"_numberMatched string, member array<struct<{one}>>, featureMember array<struct<{one}>>, "
                f"featureMembers array<struct<{quote(self.feature)}: array<{feature}>>>")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def raise_service_error(root: ET.Element) -> None:
    """Services answer errors with a document of their own."""
    if _local(root.tag) in ("ExceptionReport", "ServiceExceptionReport"):
        raise ValueError("Service exception: " + " ".join(" ".join(root.itertext()).split())[:500])


def gml_layout(page: str) -> GmlLayout | None:
    """Element names found on one page; None when it has no members."""
    root = ET.fromstring(page)
    raise_service_error(root)
    if _local(root.tag) != "FeatureCollection":
        raise ValueError("Expected a GML FeatureCollection")
    members = [f for m in root if _local(m.tag) in ("member", "featureMember", "featureMembers") for f in m]
    attributes, geometries = {}, {}
    for feature in members:
        for child in feature:
            inner = {_local(e.tag) for e in child}
            if _local(child.tag) != "boundedBy":
                (geometries if inner & {"Point", "MultiPoint"} else attributes)[_local(child.tag)] = None
    return GmlLayout(_local(members[0].tag), tuple(attributes), tuple(geometries)) if members else None


def gml_attributes(pages: DataFrame) -> DataFrame:
    """The element names on every page, as a map named ``attributes``; only names leave the page."""
    def names(batches):
        for batch in batches:
            for text in batch["payload"]:
                found = gml_layout(text)
                inside = dict.fromkeys([*found.attributes, *found.geometries], "") if found else {}
                yield batch.iloc[:0].assign(attributes=None)[["attributes"]] if not inside else type(batch)({"attributes": [inside]})

    return pages.select("payload").mapInPandas(names, "attributes map<string,string>")


def read_gml_pages(pages: DataFrame, layout: GmlLayout, axis: str = "xy") -> DataFrame:
    """Features of GML 2 and 3 pages; ``axis='yx'`` swaps latitude-first positions."""
    # The root element decides, after comments and declarations of any length.
    bare = F.regexp_replace("payload", r"(?s)<!--.*?-->", " ")
    is_error = F.contains("payload", F.lit("ExceptionReport")) & F.rlike(
        bare, F.lit(r"^\s*(?:<[?!][^>]*>\s*)*<(?:[\w.-]+:)?(?:Service)?ExceptionReport\b"))
    text = F.when(is_error, F.raise_error(F.concat(F.lit("Service exception: "), F.substring(
        F.regexp_replace(F.regexp_replace("payload", "<[^>]*>", " "), r"\s+", " "), 1, 500)))).otherwise(F.col("payload"))
    doc = pages.select("page", F.from_xml(text, layout.schema, {"ignoreNamespace": "true", "mode": "FAILFAST"}).alias("d"))
    none = F.array().cast(f"array<{doc.select(F.col(f'd.member')[0][layout.feature].alias('f')).dtypes[0][1]}>")
    plain = lambda c: F.transform(F.coalesce(F.col(f"d.{c}"), F.array().cast(dict(doc.select(f"d.{c}").dtypes)[c])),
                                  lambda m: m[layout.feature])
    many = F.flatten(F.transform(F.coalesce("d.featureMembers", F.array().cast(dict(doc.select("d.featureMembers").dtypes)["featureMembers"])),
                                 lambda m: F.coalesce(m[layout.feature], none)))
    rows = doc.select("page", F.posexplode(F.concat(plain("member"), plain("featureMember"), many)).alias("ordinal", "f"))

    positions = []
    for g in layout.geometries:
        geometry = F.col("f")[g]
        multi = geometry["MultiPoint"]
        pos = lambda p: F.coalesce(p["pos"]["_VALUE"], p["coordinates"]["_VALUE"])
        singles = F.coalesce(F.transform(multi["pointMember"], lambda m: pos(m["Point"])), F.array().cast("array<string>"))
        grouped = F.coalesce(F.flatten(F.transform(multi["pointMembers"], lambda m: F.transform(m["Point"], pos))),
                             F.array().cast("array<string>"))
        members = F.concat(singles, grouped)
        positions.append(F.when(multi.isNotNull() & (F.size(members) != 1), F.raise_error(
            F.lit("Only single-point GML MultiPoint features are supported")))
            .when(multi.isNotNull(), members[0]).otherwise(pos(geometry["Point"])))
    position = F.coalesce(*positions) if positions else F.lit(None).cast("string")
    parts = F.split(trimmed(F.coalesce(position, F.raise_error(F.lit("Only GML Point geometries are supported")))), r"[\s,]+")
    first, second = (to_number(F.get(parts, F.lit(i))) for i in (0, 1))
    lon, lat = (second, first) if axis == "yx" else (first, second)
    # A nil element is missing; an element without content is empty text.
    value = lambda a: F.when(F.col("f")[a].isNotNull() & (F.coalesce(F.col("f")[a]["_nil"], F.lit("")) != "true"),
                             F.coalesce(F.col("f")[a]["_VALUE"], F.lit("")))
    cells = [x for a in layout.attributes for x in (F.lit(a), value(a))]
    properties = F.create_map(*cells) if cells else F.create_map().cast("map<string,string>")
    return rows.select(F.col("page").alias("__page"), F.col("ordinal").alias("__ordinal"),
                       F.coalesce("f._id", "f._fid").alias("__id"), lon.alias("__lon"), lat.alias("__lat"),
                       properties.alias("__properties"))


def infer_gml_schema(features: DataFrame, layout: GmlLayout, hints: Sequence[Field] = ()) -> list[Field]:
    """Kinds of text-only attributes: a first filled value that is a time makes a date."""
    known = {f.name: f for f in hints}
    new = [a for a in layout.attributes if a not in known]
    at = F.struct("__page", "__ordinal")
    firsts = [F.min_by(F.col("__properties")[a], F.when(F.col("__properties")[a].isNotNull(), at)).alias(f"v{i}")
              for i, a in enumerate(new)]
    kinds = features.agg(*firsts).select(*[parse_utc(F.col(f"v{i}")).isNotNull() for i in range(len(new))]).first() if new else ()
    return [*hints, *[Field(a, DATE if is_date else STRING) for a, is_date in zip(new, kinds)]]


def gml_points(features: DataFrame, fields: Sequence[Field], name: str = "Dataset", time_field: str = "") -> PointTable:
    """Typed points of decoded GML features."""
    return _points(features, [F.try_element_at("__properties", F.lit(f.name)) for f in fields], fields, name, time_field)


# --- typing ---------------------------------------------------------------

def _typed(text: Column, f: Field) -> Column:
    """Service text to its kind; a filled value that does not fit fails the load."""
    if f.kind == STRING:
        return text.alias(f.name)
    read, kind = {NUMBER: (to_number, "double"), DATE: (parse_utc, "timestamp"), BOOLEAN: (to_flag, "boolean")}[f.kind]
    empty = is_blank(text) if f.kind == NUMBER else text.isNull()
    bad = F.raise_error(F.concat(F.lit(f"Invalid {f.kind} in {f.name}: "), text)).cast(kind)
    return F.when(empty, F.lit(None)).when(read(text).isNull(), bad).otherwise(read(text)).alias(f.name)


def _points(features: DataFrame, values: Sequence[Column], fields: Sequence[Field], name: str, time_field: str) -> PointTable:
    """Row ids follow page order, then the order on the page."""
    row, id, lon, lat = (unique_name(n, [f.name for f in fields]) for n in ("row_id", "point_id", "lon", "lat"))
    rows = features.select(
        (F.shiftleft(F.col("__page").cast("bigint"), PAGE_SHIFT) + F.col("__ordinal")).alias(row), F.col("__id").alias(id),
        F.col("__lon").alias(lon), F.col("__lat").alias(lat), *[_typed(v, f) for v, f in zip(values, fields)])
    return PointTable(rows, tuple(fields), row, id, lon, lat, name, time_field)
