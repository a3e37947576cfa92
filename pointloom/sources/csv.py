"""CSV files to typed point tables, with an account of every row.

Files are read as numbered lines, so they stay splittable. Only when a quote can
reach over a line end are lines put together into records, by carrying one bit of
quote state from block to block.
"""

from __future__ import annotations

import io
import re
from collections.abc import Mapping, Sequence
from csv import reader as csv_reader
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.geo import coordinates_ok
from ..functions.values import (MAX_DOUBLE, NUMBER_PATTERN, SPACES, boolean_in, finite, number_in, number_text, time_in, to_number,
                                trimmed)
from ..operators.expressions import load_rules
from ..operators.integrity import LoadError
from ..session import checkpoint, hint_if_small, require_utc, scratch_folder
from ..table import BOOLEAN, DATE, NUMBER, STRING, Field, PointTable, quote, unique_name
from .bounds import LoadBounds, bound_box, bound_time
from .config import SourceConfig, check_type_overrides

# Reasons of rejected rows.
MALFORMED = "Malformed CSV quoting"
NOT_DECIMAL = "Longitude and latitude must be decimal numbers"
EXAMPLE_LINES = 5
OUTCOME = "__outcome"

IS_NUMBER, IS_BOOLEAN, IS_TEXT = 1, 2, 4

FILE_SHIFT = 36  # line numbers of one file fit below this bit of a row id


# --- numbered lines -------------------------------------------------------

@dataclass(frozen=True)
class _Patterns:
    """Regular expressions for one delimiter. Possessive forms keep long lines cheap."""

    delimiter: str

    @property
    def _d(self) -> str:
        return "\\t" if self.delimiter == "\t" else self.delimiter

    @property
    def _rest_closed(self) -> str:
        """From inside a quoted field to its end."""
        return f'[^"]*+"(?:[^"{self._d}]*+"[^"]*+")*+[^"{self._d}]*+'

    @property
    def _rest_open(self) -> str:
        """From inside a quoted field to a line end that is still quoted."""
        return f'[^"]*+(?:"[^"{self._d}]*+"[^"]*+)*+'

    @property
    def _fields(self) -> str:
        return f'(?:(?:"{self._rest_closed}|[^"{self._d}][^{self._d}]*+)?+{self._d})*+'

    @property
    def opens(self) -> str:
        """A line that starts between records and ends inside quotes."""
        return f'(?s)^{self._fields}"{self._rest_open}$'

    @property
    def stays(self) -> str:
        """A line that starts inside quotes and ends inside quotes."""
        return f'(?s)^(?:{self._rest_open}|{self._rest_closed}{self._d}{self._fields}"{self._rest_open})$'

    @property
    def well_formed(self) -> str:
        one = f'(?:"[^"]*+(?:""[^"]*+)*+"|[^"{self._d}]*+)'
        return f"(?s)^{one}(?:{self._d}{one})*+$"

    @property
    def padded(self) -> str:
        """A row with white space or quotes, whose cells may need trimming."""
        return f'["{SPACES}]'

    @property
    def blank(self) -> str:
        return "^\ufeff?[ ]*\r?$" if self.delimiter == "\t" else "^\ufeff?[ \t]*\r?$"


def _raw_lines(spark: SparkSession, path: str | Sequence[str], patterns: _Patterns) -> DataFrame:
    """Lines with the block they come from and how they pass quotes on."""
    text = spark.read.option("lineSep", "\n").text(path if isinstance(path, str) else list(path))
    quoted = F.contains("value", F.lit('"'))
    return text.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        (quoted & F.rlike("value", F.lit(patterns.opens))).alias("opens"),
        (~quoted | F.rlike("value", F.lit(patterns.stays))).alias("stays"))


def bare_return(line: Column) -> Column:
    """In a line that starts outside quotes: a carriage return with text after it that does not stand inside quotes either."""
    closed = F.regexp_replace(line, '"[^"]*+"', "q")
    return F.contains(line, F.lit("\r")) & F.rlike(F.regexp_replace(closed, '(?s)".*', "q"), F.lit("\r[^\r]"))


def _bare_returns_fail(file: str | None) -> None:
    if file is not None:
        raise LoadError(f"{file} ends lines with a carriage return alone; convert them to line feeds first")


def _number_lines(lines: DataFrame, patterns: _Patterns) -> tuple[DataFrame, DataFrame, int, bool]:
    """Lines with ``file_no``, ``line`` and the header's line; the block table, its size, and if quotes span lines.

    One counting pass makes a table with a row per block. A line's number is the lines
    of earlier blocks plus its place in its own block, which one task reads in order.
    """
    filled = ~F.rlike("value", F.lit(patterns.blank))
    per_block = lines.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("lines"), F.min("at").alias("first"),
        F.min(F.when(filled, F.col("at"))).alias("filled"), F.min_by("value", F.when(filled, F.col("at"))).alias("head"),
        F.bool_or(F.col("opens") | ~F.col("stays")).alias("spans"),
        F.bool_or(~F.is_valid_utf8("value")).alias("damaged"),
        F.bool_or(bare_return(F.col("value"))).alias("bare_returns"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    base = F.coalesce(F.sum("lines").over(earlier), F.lit(0))
    # One row per 128 MB of text, so ordering the files in one task is cheap.
    blocks = checkpoint(
        per_block.withColumn("base", base)
        .withColumn("filled", F.col("base") + F.col("filled") - F.col("first") + 1)
        .withColumn("header", F.min("filled").over(whole))
        .withColumn("file_no", (F.dense_rank().over(Window.orderBy("file")) - 1).cast("bigint")))
    size = blocks.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or("spans"), F.lit(False)).alias("spans"),
        F.min(F.when(F.col("damaged"), F.col("file"))).alias("damaged"), F.min(F.when(F.col("bare_returns"), F.col("file"))).alias("bare_returns"),
        F.countDistinct(F.when(F.col("filled") == F.col("header"), F.rtrim("head", F.lit("\r")))).alias("heads")).first()
    if size["damaged"]:
        raise LoadError(f"{size['damaged']} holds bytes that are not UTF-8")
    if not size["spans"]:  # else some lines start inside quotes; they are judged when that is known
        _bare_returns_fail(size["bare_returns"])
    if size["heads"] > 1:
        raise LoadError("The files of one load do not have the same header")
    starts = hint_if_small(blocks.select("file", "block", "first", "base", "header", "file_no"), size["n"])
    numbered = (lines.join(starts, ["file", "block"])
                .withColumn("line", F.col("base") + F.col("at") - F.col("first") + 1)
                .select("file_no", "block", "line", "header", "value", "opens", "stays"))
    return numbered, blocks, size["n"], size["spans"]


def _records(lines: DataFrame, block_count: int) -> DataFrame:
    """Put lines together into records where quotes reach over line ends.

    A line keeps, flips or sets the quote state. The state before a line follows from
    the last line that set it and the flips since: running values inside each block,
    plus one carried row per block.
    """
    flips, sets = F.col("opens") & ~F.col("stays"), F.col("opens") == F.col("stays")
    order = Window.partitionBy("file_no", "block").orderBy("line")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    local = lines.withColumn("flipped", F.coalesce(F.sum(flips.cast("int")).over(earlier), F.lit(0)))
    setting = F.when(sets, F.struct(F.col("opens").cast("int").alias("open"), F.col("flipped").alias("flipped")))
    local = local.withColumn("set", F.last(setting, ignorenulls=True).over(earlier))

    blocks = Window.partitionBy("file_no").orderBy("block")
    carried = blocks.rowsBetween(Window.unboundedPreceding, -1)
    ends = (local.groupBy("file_no", "block").agg(F.sum(flips.cast("int")).alias("flips"),
                                                   F.max_by(setting, F.when(sets, F.col("line"))).alias("set")))
    ends = ends.withColumn("fixed", (F.col("set.open") + F.col("flips") - F.col("set.flipped")) % 2)
    ends = ends.withColumn("loose", F.coalesce(F.sum(F.when(F.col("fixed").isNull(), F.col("flips"))).over(carried), F.lit(0)))
    known = F.when(F.col("fixed").isNotNull(), F.struct("fixed", "loose"))
    ends = ends.withColumn("known", F.last(known, ignorenulls=True).over(carried))
    start = (F.coalesce(F.col("known.fixed"), F.lit(0)) + F.col("loose") - F.coalesce(F.col("known.loose"), F.lit(0))) % 2
    starts = hint_if_small(ends.select("file_no", "block", start.alias("start")), block_count)

    inside = F.coalesce((F.col("set.open") + F.col("flipped") - F.col("set.flipped")) % 2,
                        (F.col("start") + F.col("flipped")) % 2) == 1
    state = checkpoint(
        local.join(starts, ["file_no", "block"]).withColumn("inside", inside)
        .withColumn("open", F.when(F.col("inside"), F.col("stays")).otherwise(F.col("opens")))
        .select("file_no", "block", "line", "header", "value", "inside", "open"))

    # Of a line that starts inside quotes only what follows the closing quote can end a record.
    closing = '(?s)^[^"]*+(?:""[^"]*+)*+"'
    outside = F.when(~F.col("inside"), F.col("value")).when(F.rlike("value", F.lit(closing)), F.regexp_replace("value", closing, "q"))
    unfinished = state.groupBy("file_no").agg(F.max_by("open", "line").alias("open"),
                                              F.max(F.when(~F.col("inside"), F.col("line"))).alias("from"),
                                              F.min(F.when(bare_return(outside), F.col("line"))).alias("bare"))
    bare = unfinished.where("bare IS NOT NULL").limit(1).collect()
    if bare:
        _bare_returns_fail(f"A file (line {bare[0]['bare']})")
    left = unfinished.where("open").limit(1).collect()
    if left:
        raise LoadError(f"Nothing was loaded: a quote is never closed, in a record starting on CSV line {left[0]['from']}")

    single = state.where(~F.col("inside") & ~F.col("open")).select("file_no", "line", "header", "value")
    spread = state.where(F.col("inside") | F.col("open"))
    first = F.last(F.when(~F.col("inside"), F.col("line")), ignorenulls=True)
    last_start = hint_if_small(
        spread.groupBy("file_no", "block").agg(F.max(F.when(~F.col("inside"), F.col("line"))).alias("latest"))
        .withColumn("before", F.last("latest", ignorenulls=True).over(carried)).select("file_no", "block", "before"),
        block_count)
    joined = (spread.withColumn("own", first.over(order)).join(last_start, ["file_no", "block"])
              .groupBy("file_no", F.coalesce("own", "before").alias("start"))
              .agg(F.first("header").alias("header"), F.array_sort(F.collect_list(F.struct("line", "value"))).alias("parts"))
              .select("file_no", F.col("start").alias("line"), "header",
                      F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value")))
    return single.unionByName(joined)


# --- header and types -----------------------------------------------------

def csv_headers(spark: SparkSession, path: str | Sequence[str], delimiter: str = ",") -> list[str]:
    """Column names of the first file; only its first lines are read."""
    patterns = _Patterns(delimiter)
    paths = [path] if isinstance(path, str) else list(path)
    files = spark.read.text(paths).inputFiles()
    if not files:
        raise LoadError("There is no CSV file, or nothing in it")
    first = spark.read.option("lineSep", "\n").text(min(files))
    wanted, record = 16, None
    while record is None:
        lines = [r[0] for r in first.take(wanted)]
        record = _header_record(lines, patterns)
        if record is None and len(lines) < wanted:
            raise LoadError("A column has no header, or two have the same")
        wanted *= 4
    if not re.match(patterns.well_formed, record):
        raise LoadError(f"CSV header: {MALFORMED}")
    names = [h.strip() for h in next(csv_reader(io.StringIO(record, newline=""), delimiter=delimiter))]
    if not all(names) or len(set(names)) != len(names):
        raise LoadError("A column has no header, or two have the same")
    return names


def _header_record(lines: Sequence[str], patterns: _Patterns) -> str | None:
    """The first filled record, once its quotes are closed."""
    record = None
    for text in lines:
        if record is None:
            if re.match(patterns.blank, text):
                continue
            record, still = text.lstrip("\ufeff"), patterns.opens
        else:
            record, still = record + "\n" + text, patterns.stays
        if not re.match(still, text.lstrip("\ufeff")):
            return record.removesuffix("\r")
    return None


@dataclass(frozen=True)
class CsvRecords:
    """Records of a load with their cells; ``__problem`` says why a record has none."""

    headers: tuple[str, ...]
    rows: DataFrame
    config: SourceConfig
    #: ``file_no, file``: one row per file that was read.
    files: DataFrame | None = None

    def cell(self, name: str) -> Column:
        """Text of one column as it stands in the file."""
        return F.get("__cells", F.lit(self.headers.index(name)))

    def text(self, name: str) -> Column:
        """Text of one column without white space around it; nothing is empty text."""
        return F.get("__texts", F.lit(self.headers.index(name)))


def read_records(spark: SparkSession, config: SourceConfig) -> CsvRecords:
    """Numbered records of all data rows: ``__row, __file, __line, __problem, __cells``."""
    config.check()
    require_utc(spark)
    patterns = _Patterns(config.delimiter)
    headers = csv_headers(spark, config.path, config.delimiter)
    numbered, blocks, block_count, spans = _number_lines(_raw_lines(spark, config.path, patterns), patterns)
    records = _records(numbered, block_count) if spans else numbered.select("file_no", "line", "header", "value")
    d = config.delimiter
    value, quoted = F.col("raw"), F.contains("raw", F.lit('"'))
    rows = (records.where((F.col("line") != F.col("header")) & ~F.rlike("value", F.lit(patterns.blank)))
            .select((F.shiftleft("file_no", FILE_SHIFT) + F.col("line")).alias("__row"), F.col("file_no").alias("__file"),
                    F.col("line").alias("__line"), F.rtrim("value", F.lit("\r")).alias("raw"))
            .withColumn("__plain", F.when(~quoted, F.split("raw", d, -1))))
    bare = F.regexp_replace("raw", '"[^"]*+"', "")
    found = F.when(quoted, F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit(""))) + 1).otherwise(F.size("__plain"))
    problem = (F.when(quoted & ~F.rlike("raw", F.lit(patterns.well_formed)), F.lit(MALFORMED))
               .when(found != len(headers), F.concat(F.lit(f"Expected {len(headers)} columns; found "), found.cast("string"))))
    schema = ", ".join(f"c{i} string" for i in range(len(headers)))
    # Blank and quoted-empty cells mean the same, so no null marker is wanted.
    parsed = F.from_csv(value, schema, {"sep": d, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": "\u0001",
                                        "emptyValue": "", "maxColumns": str(len(headers) + 1)})
    # Rows without quotes split at the delimiter; only the others need the CSV parser.
    rows = rows.withColumn("__problem", problem).withColumn("__parsed", F.when(quoted & F.col("__problem").isNull(), parsed))
    cells = F.when(quoted, F.array(*[F.col(f"__parsed.c{i}") for i in range(len(headers))])).otherwise(F.col("__plain"))
    rows = rows.select("__row", "__file", "__line", "__problem", F.when(F.col("__problem").isNull(), cells).alias("__cells"),
                       F.rlike("raw", F.lit(patterns.padded)).alias("__padded"))
    return CsvRecords(tuple(headers), with_texts(rows), config, blocks.select("file_no", "file").distinct())


def with_texts(rows: DataFrame) -> DataFrame:
    """Add ``__texts``: the cells without white space around them. Few rows have any."""
    empty = F.transform("__cells", lambda c: trimmed(F.coalesce(c, F.lit(""))))
    return rows.withColumn("__texts", F.when(F.col("__padded"), empty).otherwise(F.col("__cells"))).drop("__padded")


def infer_csv_types(records: CsvRecords) -> DataFrame:
    """What the filled cells of every column look like over the whole file, in one aggregate.

    Result: ``column, present, is_number, is_boolean``. Each cell is classed by one bit
    and a column is the union of its bits, so the work per cell is the same for any
    number of columns.
    """
    # Rows with a problem have no cells and fall into the null group.
    text = records.rows.select(F.posexplode_outer("__texts").alias("at", "t"))
    is_number = F.abs(number_in(F.col("t"))) <= F.lit(MAX_DOUBLE)
    bit = (F.when(F.col("t") == "", F.lit(0)).when(is_number, F.lit(IS_NUMBER))
           .when(F.lower("t").isin("true", "false"), F.lit(IS_BOOLEAN)).otherwise(F.lit(IS_TEXT)))
    found = text.groupBy("at").agg(F.bit_or(bit).alias("bits"))
    names = F.array(*[F.lit(n) for n in records.headers])
    # Columns of a file without rows are listed too.
    every = records.rows.sparkSession.range(len(records.headers)).select(F.col("id").cast("int").alias("at"))
    bits = F.coalesce("bits", F.lit(0))
    return (every.join(F.broadcast(found), "at", "left")  # one row per column
            .select(F.element_at(names, F.col("at") + 1).alias("column"), (bits != 0).alias("present"),
                    (bits == IS_NUMBER).alias("is_number"), (bits == IS_BOOLEAN).alias("is_boolean")))


def csv_kind(present: bool, is_number: bool, is_boolean: bool) -> str:
    """Kind of a column from its whole-file facts; a blank column is text."""
    return NUMBER if present and is_number else BOOLEAN if present and is_boolean else STRING


def apply_type_overrides(headers: Sequence[str], inferred: Mapping[str, str], config: SourceConfig) -> tuple[Field, ...]:
    """Overrides first, then the time column, then what the cells look like."""
    check_type_overrides(config.field_types, headers, config.time_field)
    pick = lambda n: config.field_types.get(n) or (DATE if n == config.time_field else inferred[n])
    return tuple(Field(n, pick(n)) for n in headers)


def describe_csv(records: CsvRecords) -> tuple[Field, ...]:
    """Typed schema of a CSV load."""
    inferred = {r["column"]: csv_kind(r["present"], r["is_number"], r["is_boolean"])
                for r in infer_csv_types(records).collect()}
    return apply_type_overrides(records.headers, inferred, records.config)


# --- points ---------------------------------------------------------------

def decode_point_xy(lon: Column, lat: Column, lon_name: str, lat_name: str) -> tuple[Column, Column, Column]:
    """Two trimmed decimal cells to ``(lon, lat, problem)``."""
    decimal = lambda t: F.rlike(t, F.lit(NUMBER_PATTERN))
    problem = (F.when(lon == "", F.lit(f'Missing longitude in "{lon_name}"'))
               .when(lat == "", F.lit(f'Missing latitude in "{lat_name}"'))
               .when(~decimal(lon) | ~decimal(lat), F.lit(NOT_DECIMAL)))
    return number_in(lon), number_in(lat), problem


def decode_point_wkt(text: Column, name: str) -> tuple[Column, Column, Column]:
    """``POINT (lon lat)`` in any case to ``(lon, lat, problem)``."""
    pattern = r"(?i)^\s*POINT\s*\(\s*(\S+)\s+(\S+)\s*\)\s*$"
    lon, lat = (F.regexp_extract(text, pattern, i) for i in (1, 2))
    decimal = F.rlike(lon, F.lit(NUMBER_PATTERN)) & F.rlike(lat, F.lit(NUMBER_PATTERN))
    return to_number(lon), to_number(lat), F.when(~decimal, F.lit(f'Expected WKT POINT (longitude latitude) in "{name}"'))


def decode_point_geojson(text: Column, name: str) -> tuple[Column, Column, Column]:
    """A GeoJSON Point in a text cell to ``(lon, lat, problem)``."""
    point = F.try_parse_json(text)
    part = lambda i: F.try_variant_get(point, f"$.coordinates[{i}]", "double")
    numeric = lambda i: F.coalesce(F.rlike(F.schema_of_variant(F.try_variant_get(point, f"$.coordinates[{i}]", "variant")),
                                           F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")), F.lit(False))
    # A number beyond 64 bits parses to a double or decimal, so these are all number types.
    fits = F.coalesce(F.try_variant_get(point, "$.type", "string") == "Point", F.lit(False)) & numeric(0) & numeric(1)
    problem = (F.when(point.isNull(), F.lit(f'Invalid GeoJSON JSON in "{name}"'))
               .when(~fits, F.lit(f'Expected a GeoJSON Point geometry in "{name}"')))
    return part(0), part(1), problem


def _need(headers: Sequence[str], name: str, purpose: str) -> str:
    if not name:
        raise LoadError(f"No {purpose} column is named")
    if name not in headers:
        raise LoadError(f"The {purpose} column {name} is not in the header")
    return name


def validate_rows(records: CsvRecords, fields: Sequence[Field], bounds: LoadBounds | None = None) -> DataFrame:
    """Type and judge every row: the first failing rule is its ``reject_reason``.

    Result: ``row_id, line, point_id, lon, lat``, one typed column per attribute,
    ``reject_reason`` and ``filtered``. Order of rules: structure, geometry, coordinate
    range, columns from left to right, load rules, missing time, time range, box.
    """
    bounds, config, headers = (bounds or LoadBounds()).check(), records.config, records.headers
    if config.geometry_mode == "xy":
        names = (_need(headers, config.longitude_field, "longitude"), _need(headers, config.latitude_field, "latitude"))
        lon, lat, geometry = decode_point_xy(records.text(names[0]), records.text(names[1]), *names)
    else:
        name = _need(headers, config.geometry_field, "geometry")
        decode = decode_point_wkt if config.geometry_mode == "wkt" else decode_point_geojson
        lon, lat, geometry = decode(records.cell(name), name)
    if config.time_field:
        _need(headers, config.time_field, "time")
    if bounds.time and not config.time_field:
        raise LoadError("A time range needs a time column")

    # Small steps, each of which reads the columns of the one before: cells are typed once.
    read = {NUMBER: number_in, DATE: time_in, BOOLEAN: boolean_in}
    message = {NUMBER: 'Invalid number in "{}"', DATE: 'Invalid ISO 8601 time in "{}"', BOOLEAN: 'Expected true or false in "{}"'}
    typed, shown, wrong = [], [], []
    for i, f in enumerate(fields):
        text, value = records.text(f.name), F.col(quote(f.name))
        if f.kind == STRING:
            typed.append(F.when(text != "", records.cell(f.name)).alias(f.name))
        else:
            typed.append(read[f.kind](text).alias(f.name))
            wrong.append(F.when((text != "") & value.isNull(), F.lit(message[f.kind].format(f.name))))
        shown.append(finite(value).alias(f.name) if f.kind == NUMBER else value)

    taken = [f.name for f in fields]
    name_of = {n: unique_name(n, taken) for n in ("row_id", "line", "point_id", "lon", "lat", "reject_reason", "filtered")}
    file_no, line = F.col("__file"), F.col("__line").cast("string")
    id = F.when(file_no == 0, F.concat(F.lit("csv."), line)).otherwise(
        F.concat(F.lit("csv."), (file_no + 1).cast("string"), F.lit("."), line))
    kept = ("__row", "__file", "__line", "__problem", "__texts", "__lon", "__lat", "__geometry")
    rows = (records.rows.select(*kept[:5], lon.alias("__lon"), lat.alias("__lat"), geometry.alias("__geometry"), *typed)
            .select(*kept, *shown))

    lon, lat = F.col("__lon"), F.col("__lat")
    range_problem = F.when(~coordinates_ok(lon, lat), F.concat(
        F.lit("Coordinate is invalid: longitude "), number_text(lon), F.lit(", latitude "), number_text(lat),
        F.lit(". Expected finite WGS84 degrees.")))
    failed = F.coalesce("__problem", "__geometry", range_problem, *wrong)
    passes = F.coalesce(load_rules(config.load_rules, fields), F.lit(False))
    outside = ~passes
    if bounds.time:
        time = F.col(quote(config.time_field))
        no_time = F.lit(f'Missing time in "{config.time_field}" required by the selected time bounds')
        failed = F.coalesce(failed, F.when(passes & time.isNull(), no_time))
        outside = outside | ~F.coalesce(bound_time(time, bounds), F.lit(False))
    if bounds.box:
        outside = outside | ~F.coalesce(bound_box(lon, lat, bounds), F.lit(False))
    judged = rows.withColumn("__reason", failed)
    return judged.select(
        F.col("__row").alias(name_of["row_id"]), F.col("__line").alias(name_of["line"]), id.alias(name_of["point_id"]),
        lon.alias(name_of["lon"]), lat.alias(name_of["lat"]), *[F.col(quote(f.name)) for f in fields],
        F.col("__reason").alias(name_of["reject_reason"]),
        (F.col("__reason").isNull() & outside).alias(name_of["filtered"]))


def stage_rows(judged: DataFrame, path: str, reason: str = "reject_reason", filtered: str = "filtered") -> DataFrame:
    """Write judged rows once, apart by outcome, and read them back.

    Text is parsed a single time this way; reports then read only rejected rows and
    queries only imported ones.
    """
    outcome = (F.when(F.col(quote(reason)).isNotNull(), F.lit("rejected")).when(F.col(quote(filtered)), F.lit("filtered"))
               .otherwise(F.lit("imported")))
    judged.withColumn(OUTCOME, outcome).write.mode("errorifexists").partitionBy(OUTCOME).parquet(path)
    # The schema is known, so a load without rows reads back as well.
    schema = T.StructType([*judged.schema.fields, T.StructField(OUTCOME, T.StringType())])
    return judged.sparkSession.read.schema(schema).parquet(path)


def import_report(staged: DataFrame, reason: str = "reject_reason", line: str = "line", row: str = "row_id",
                  files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Totals of staged rows in one row, and per reason a count with its first five line numbers.

    The first are those of the first files. With a table of the files, ``files`` names the file of
    each of ``lines``. The lists keep at most five per reason before the shuffle, so even a reason
    that covers most rows stays small.
    """
    outcome = F.col(OUTCOME)
    totals = staged.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(outcome == n).alias(n) for n in ("imported", "rejected", "filtered")])
    bad = staged.where(outcome == "rejected").select(
        F.col(quote(reason)).alias("reason"), F.col(quote(line)).alias("line"), F.col(quote(row)).alias("row"))
    counts = bad.groupBy("reason").agg(F.count(F.lit(1)).alias("count"), F.min("row").alias("first_row"))
    first = Window.partitionBy("reason").orderBy("row")
    examples = bad.withColumn("n", F.row_number().over(first)).where(F.col("n") <= EXAMPLE_LINES)
    shown = ["lines"]
    if files is not None:
        examples = examples.join(files, F.shiftright("row", FILE_SHIFT) == F.col("file_no"))
        shown.append("files")
    places = F.array_sort(F.collect_list(F.struct("n", "line", *(["file"] if files is not None else []))))
    listed = examples.groupBy("reason").agg(places.alias("places")).select("reason", *[F.col(f"places.{c[:-1]}").alias(c) for c in shown])
    return totals, counts.join(listed, "reason").orderBy("first_row").drop("first_row")


@dataclass(frozen=True)
class CsvLoad:
    """Result of a CSV load; ``staged`` holds every row with its outcome, ``issues`` the rejected ones by reason, with files and lines of the first."""

    table: PointTable
    staged: DataFrame
    totals: Mapping[str, int]
    issues: DataFrame

    def summary(self) -> str:
        t = self.totals
        return (f"CSV: {t['imported']:,} of {t['total']:,} data rows imported; {t['rejected']:,} rejected; "
                f"{t['filtered']:,} excluded by bounds or load rules.")


def load_csv(spark: SparkSession, config: SourceConfig, bounds: LoadBounds | None = None, path: str | None = None) -> CsvLoad:
    """Types, validation and report of a CSV source, staged as Parquet under ``path``."""
    records = read_records(spark, config)
    # Quotes are put together and cells cut out once; types and values then read the cells.
    cells = scratch_folder(spark)
    records.rows.write.parquet(cells)
    records = replace(records, rows=spark.read.schema(records.rows.schema).parquet(cells))
    fields = describe_csv(records)
    names = [f.name for f in fields]
    id_of = lambda n: unique_name(n, names)
    reason, filtered, line = id_of("reject_reason"), id_of("filtered"), id_of("line")
    staged = stage_rows(validate_rows(records, fields, bounds), path or scratch_folder(spark), reason, filtered)
    totals_df, issues = import_report(staged, reason, line, id_of("row_id"), records.files)
    totals = totals_df.first().asDict()
    if totals["total"] and totals["rejected"] == totals["total"]:
        raise LoadError(f"Every one of the {totals['total']:,} CSV rows was rejected; first reason: {issues.first()['reason']}")
    kept = staged.where(F.col(OUTCOME) == "imported").drop(reason, filtered, line, OUTCOME)
    table = PointTable(kept, fields, id_of("row_id"), id_of("point_id"), id_of("lon"), id_of("lat"), config.name, config.time_field)
    return CsvLoad(table, staged, totals, issues)
