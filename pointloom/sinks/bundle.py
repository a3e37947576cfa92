"""Backups: every table of an analysis in full, with a manifest that is checked on the way in."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import SparkSession, functions as F

from ..plans.spec import AnalysisSpec, SpecError, migrate_spec, validate_spec
from ..table import Field, PointTable, kind_of

# Fixed values.
FORMAT, VERSION, MAX_SOURCES = "pointloom-bundle", 1, 8
MANIFEST = "manifest"


def _entry(source: str, table: PointTable, folder: str) -> dict:
    return {"id": source, "name": table.name, "folder": folder, "time_field": table.time_field,
            "identity": list(table.identity), "fields": [[f.name, f.kind] for f in table.fields]}


def export_bundle(spark: SparkSession, path: str, tables: Mapping[str, PointTable], spec: AnalysisSpec | None = None) -> None:
    """Write whole tables, disabled sources included, and then the manifest that lists them."""
    if len(tables) > MAX_SOURCES:
        raise SpecError(f"A bundle holds at most {MAX_SOURCES} sources")
    entries = []
    for i, (source, table) in enumerate(tables.items(), 1):
        folder = f"table-{i}"
        table.df.write.mode("errorifexists").parquet(f"{path}/{folder}")
        rows = spark.read.parquet(f"{path}/{folder}").count()
        entries.append({**_entry(source, table, folder), "rows": rows})
    manifest = {"format": FORMAT, "version": VERSION, "tables": entries, "analysis": spec.to_dict() if spec else None}
    text = json.dumps(manifest, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/{MANIFEST}")


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest, checked for shape: known version, unique ids, each folder used once."""
    try:
        manifest = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/{MANIFEST}").limit(2).collect()))
    except Exception as error:
        raise SpecError("Bundle has no readable manifest") from error
    if not isinstance(manifest, dict) or manifest.get("format") != FORMAT or manifest.get("version") != VERSION:
        raise SpecError("Unsupported bundle format or version")
    entries = manifest.get("tables")
    if not isinstance(entries, list) or len(entries) > MAX_SOURCES:
        raise SpecError("Invalid bundle manifest")
    for key in ("id", "folder"):
        seen = [e.get(key) for e in entries]
        if not all(isinstance(v, str) and v for v in seen) or len(set(seen)) != len(seen):
            raise SpecError("Bundle sources and folders must be unique")
    return manifest


def stored_folders(spark: SparkSession, path: str) -> set[str]:
    """Folders a bundle really holds, through the file system Spark uses for the path."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    listing = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    return {s.getPath().getName() for s in listing if s.isDirectory()}


def import_bundle(spark: SparkSession, path: str) -> tuple[dict[str, PointTable], AnalysisSpec | None]:
    """Read a bundle back; missing, extra or altered tables are refused."""
    manifest = read_manifest(spark, path)
    expected = {e["folder"] for e in manifest["tables"]} | {MANIFEST}
    if stored_folders(spark, path) != expected:
        raise SpecError("Bundle contains unexpected or missing tables")
    tables = {}
    for e in manifest["tables"]:
        df = spark.read.parquet(f"{path}/{e['folder']}")
        fields = tuple(Field(n, k) for n, k in e["fields"])
        types = {f.name: f.dataType for f in df.schema.fields}
        if any(f.name not in types or kind_of(types[f.name]) != f.kind for f in fields) \
                or any(c not in types for c in e["identity"]):
            raise SpecError(f"Table of source {e['id']} does not have its recorded schema")
        if df.agg(F.count(F.lit(1))).first()[0] != e["rows"]:
            raise SpecError(f"Table of source {e['id']} does not have its recorded rows")
        tables[e["id"]] = PointTable(df, fields, *e["identity"], name=e["name"], time_field=e["time_field"])
    saved = manifest.get("analysis")
    return tables, AnalysisSpec.from_dict(validate_spec(migrate_spec(saved))) if saved else None

