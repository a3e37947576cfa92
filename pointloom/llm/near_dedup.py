"""Near duplicates by a chosen-path set similarity join.

Equal shingle sets become one class first. In each tree a class follows the path of its own minwise
tokens: at every level a random function selects one token of the set, and classes that select the
same one stay together. A node with few classes is compared exhaustively; a node with many branches
on. Trees are independent and repeated, so a pair that one tree parts meets in another: sets that
share 85 % part by the first level of all sixteen trees with a chance of 1e-13, by the fourth of all
with 1e-5, by the sixth with 5e-4. A node that is still large at the last level is compared in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pointloom.llm.common import WORD, lower_az, text_of
from pointloom.llm.linking import LIMIT, link_groups
from pointloom.llm.shingles import sketch
from pointloom.session import checkpoint

TREES = 16
OWN_LEVELS = 6
FUNCTIONS = TREES * OWN_LEVELS
#: Depths at which nodes are counted.
DEPTHS = (1, 2, 4, 6)
#: A pair whose signatures agree in a share less by this than the asked similarity is not looked at (over three deviations).
SLACK = 0.12
SEED = 11


#: Bytes of the signature that belong to one tree.
OWN_BYTES = 4 * OWN_LEVELS


def _walks() -> Column:
    """For each tree the tokens that a class is sent along by, level by level."""
    return F.array(*(F.substring("signature", t * OWN_BYTES + 1, OWN_BYTES) for t in range(TREES)))


def settled_nodes(classes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(grp, n, key) of every node of two or more classes at which branching ended.

    A class goes down each tree with its own tokens, so that nothing is looked up on the way.
    """
    walking = classes.select("key", F.posexplode(_walks()).alias("tree", "walk"))
    done = None
    for i, depth in enumerate(DEPTHS):
        open_ = walking.withColumn("path", F.xxhash64("tree", F.substring("walk", 1, 4 * depth)))
        sizes = open_.groupBy(F.col("tree").alias("s_tree"), F.col("path").alias("s_path")).agg(F.count("*").alias("n")).where("n > 1")
        shared = checkpoint(open_.join(sizes, (F.col("tree") == F.col("s_tree")) & (F.col("path") == F.col("s_path"))).select("key", "tree", "path", "walk", "n"))
        last = i == len(DEPTHS) - 1
        here = (shared if last else shared.where(F.col("n") <= limit)).select(
            F.struct(F.lit(depth).alias("depth"), "tree", "path").alias("grp"), "n", "key")
        done = here if done is None else done.unionByName(here)
        large = shared.where(F.col("n") > limit)
        if last or large.isEmpty():
            return done
        walking = large.select("key", "tree", "walk")
    raise AssertionError


@dataclass(frozen=True)
class _Groups:
    """The rows with the hash of their text, their sets, and for every class of equal sets its component."""

    rows: DataFrame  # id, h, text
    marked: DataFrame  # id, h, n_shingles, set_key
    whole: DataFrame  # key, component_id, best (nobody, id, h: the row that stands for the component)


def _group(docs: DataFrame, percent: int, id_column: str, text_column: str, limit: int) -> _Groups:
    rows = docs.select(F.col(id_column).alias("id"), lower_az(text_of(text_column)).alias("text")).withColumn("h", F.xxhash64("text"))
    marked = checkpoint(sketch(rows, FUNCTIONS, SEED))
    # Null ids come after all others.
    at = F.struct(F.col("id").isNull().alias("nobody"), "id", "h")
    classes = checkpoint(marked.where("set_key is not null").groupBy(F.col("set_key").alias("key")).agg(
        F.min(at).alias("at"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")))

    def texts_of(keys: DataFrame) -> DataFrame:
        wanted = keys.join(classes, F.col("w") == F.col("key")).select("key", F.col("at.id").alias("w_id"), F.col("at.h").alias("w_h"))
        return rows.join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("h") == F.col("w_h"))).select("key", "text").dropDuplicates(["key"])

    labels = link_groups(settled_nodes(classes, limit), classes, texts_of, percent / 100 - SLACK, percent, limit).select("node", F.col("label").alias("l"))
    linked = checkpoint(classes.select("key", "at").join(labels, F.col("key") == F.col("node")).select("key", "at", "l"))
    best = linked.groupBy("l").agg(F.min("at").alias("best")).withColumnRenamed("l", "b_l")
    found = linked.join(best, F.col("l") == F.col("b_l")).select(F.col("key").alias("f_key"), "best")
    whole = checkpoint(classes.select("key", "at").join(found, F.col("key") == F.col("f_key"), "left").select("key", F.coalesce("best", "at").alias("best")))
    return _Groups(rows, marked, whole)


def near_duplicates(docs: DataFrame, percent: int = 85, id_column: str = "doc_id", text_column: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    A-Z is lower-cased; a text of fewer words than a shingle is one shingle, a text without words (or
    null) has none, is linked with nothing and is its own component. Links join sets with
    ``100 * intersection >= percent * union`` and are confirmed on full sets. ``component_id`` is the
    smallest id of the component; null ids have none to give, and a component of null ids only has a
    null one. ``kept`` holds where the id is the component's, so repeated rows of that id are all kept.
    Other columns are ignored.
    """
    g = _group(docs, percent, id_column, text_column, limit)
    linked = g.marked.where("set_key is not null").select("id", "n_shingles", "set_key").join(g.whole, F.col("set_key") == F.col("key")).select(
        "id", "n_shingles", F.col("best.id").alias("component_id"))
    alone = g.marked.where("set_key is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_column), "n_shingles", "component_id",
                                            F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 85, id_column: str = "doc_id", text_column: str = "text", limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs``, with all columns, that stand for their component: the smallest id, one row of it.

    Rows without words all stay. The order of columns is kept.
    """
    g = _group(docs, percent, id_column, text_column, limit)
    stay = g.whole.select(F.col("best.id").alias("_stay_id"), F.col("best.h").alias("_stay_h")).distinct()
    wordless = ~text_of(text_column).rlike(WORD)
    hashed = docs.where(~wordless).withColumn("_h", F.xxhash64(lower_az(text_of(text_column))))
    kept = hashed.join(stay, F.col(id_column).eqNullSafe(F.col("_stay_id")) & (F.col("_h") == F.col("_stay_h"))).dropDuplicates([id_column, "_h"])
    return kept.select(*docs.columns).unionByName(docs.where(wordless))
