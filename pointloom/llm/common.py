"""Small helpers that several corpus operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space that separates words, and the words themselves, as a Java and Python class.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_az(column: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case. Texts of ASCII alone take the fast way."""
    plain = F.octet_length(column) == F.char_length(column)
    return F.when(plain, F.lower(column)).otherwise(F.translate(column, string.ascii_uppercase, string.ascii_lowercase))


def sql_lower_az(column: str) -> str:
    """The same in SQL."""
    return f"translate({column}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
