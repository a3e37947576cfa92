"""Which column plays which role: by header text, or by ranked probabilities."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

# Header patterns and acceptance thresholds.
ROLE_PATTERNS = {"longitude": r"^(lon|lng|longitude|x)$", "latitude": r"^(lat|latitude|y)$", "geometry": r"^(geometry|geom|wkt)$"}
MIN_PROBABILITY, MIN_MARGIN, KEPT_CANDIDATES = 0.55, 0.10, 3


def match_point_columns(columns: Sequence[str]) -> dict[str, str]:
    """First column whose name fits each role; roles without one are left out."""
    found = {}
    for role, pattern in ROLE_PATTERNS.items():
        name = next((c for c in columns if re.search(pattern, c, re.IGNORECASE)), None)
        if name is not None:
            found[role] = name
    return found


def resolve_role_predictions(candidates: DataFrame, min_probability: float = MIN_PROBABILITY,
                             min_margin: float = MIN_MARGIN) -> DataFrame:
    """Decide a column per file and role from ``file, role, column, probability``.

    A null column stands for "none". The best candidate is accepted when it is likely
    and clearly ahead; a column that two roles of one file accept goes to neither.
    Result: ``file, role, column, probability, candidates``.
    """
    if not (0 <= min_probability <= 1 and 0 <= min_margin <= 1):
        raise ValueError("Probability settings must be between 0 and 1")
    ranking = Window.partitionBy("file", "role").orderBy(F.desc("probability"), F.asc_nulls_first("column"))
    ranked = (candidates.withColumn("rank", F.row_number().over(ranking))
              .withColumn("next", F.coalesce(F.lead("probability").over(ranking), F.lit(0.0)))
              .where(F.col("rank") <= KEPT_CANDIDATES))
    best = F.col("rank") == 1
    accepted = (F.col("probability") >= min_probability) & (F.col("probability") - F.col("next") >= min_margin)
    decided = ranked.groupBy("file", "role").agg(
        F.max(F.when(best & accepted, F.col("column"))).alias("column"), F.max(F.when(best, F.col("probability"))).alias("probability"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "column", "probability"))),
                    lambda c: F.struct(c["column"], c["probability"])).alias("candidates"))
    shared = F.count("column").over(Window.partitionBy("file", "column"))
    return decided.select("file", "role", F.when(shared == 1, F.col("column")).alias("column"), "probability", "candidates")
