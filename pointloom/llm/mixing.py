"""Mix sources to target weights, with DataFrame functions only.

1. ``measure``: words of each document, and where the document lies in the stream of words of its source.
2. ``targets``: words to take from each source.
3. ``blocks``: the stream of each source cut into blocks of a fixed number of words.
4. ``slots``: the output, shard by shard. The sources of a shard's slots are drawn independently by
   their targets, so the counts of a shard are a multinomial draw. What the draws put above a source's
   number of slots is handed to the sources that are short, so the totals are the targets'.
   The k-th slot of a source takes block ``permute(k mod blocks)`` of pass ``k div blocks``.
5. Slots join blocks by (source, block index).

No step needs the rows of a source in one task: positions are running sums within buckets plus the
totals of the buckets before, and every join is on a key that a source spreads over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pointloom.llm.common import SPACE, WORD, text_of
from pointloom.session import checkpoint

#: Words in a block, slots in a shard, and tickets looked up together when a slot draws its source.
BLOCK_WORDS = 64
SHARD_SLOTS = 8192
CELL_TICKETS = 1024
#: Documents in a bucket of a source's stream, about.
BUCKET_ROWS = 2048
#: Rounds of the index permutation.
ROUNDS = 16
WEIGHTS = (5, 2, 1)


def _row_hash(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *(F.col(c) for c in columns))


def measure(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text",
            seed: int = 0) -> DataFrame:
    """id, source, size, start, h: the words of each document and its first word's place in its source.

    Null texts have no words; a null source is a source of its own. The order within a source is
    pseudorandom and the same in every run. Checkpointed: everything else is derived from it.
    """
    words = docs.select(F.col(id_column).alias("id"), F.col(source_column).cast("string").alias("source"),
                        F.regexp_count(text_of(text_column), F.lit(WORD)).cast("long").alias("size"),
                        _row_hash(seed, id_column, source_column, text_column).alias("h"))
    sized = checkpoint(words)
    buckets = max(1, sized.count() // BUCKET_ROWS)
    sized = sized.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    inside = Window.partitionBy("source", "bucket").orderBy("h", F.col("id"))
    placed = sized.withColumn("before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    totals = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    offsets = totals.select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"),
                            (F.sum("bucket_size").over(earlier) - F.col("bucket_size")).alias("offset"))
    joined = placed.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
    return checkpoint(joined.select("id", "source", "size", (F.col("before") + F.col("offset")).alias("start"), "h"))


def targets(measured: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = 1.5, most: float = 2.0,
            block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per source: source, source_size, target, n_blocks, quota (slots) and first_ticket.

    Sources by code point, null last, weigh ``weights`` in turn and share ``budget`` times all words.
    No target exceeds ``most`` times its source's words; the excess is shared again by weight. With
    sources sorted by the level at which they are full, the full ones come first, so the level of the
    others follows from running sums.
    """
    sizes = measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight).withColumns(
        {"cap": F.col("source_size") * F.lit(most), "full_at": F.col("source_size") * F.lit(most) / F.col("weight")})
    everything, to_here = Window.partitionBy(), Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    levelled = weighed.withColumns({
        "total": F.sum("source_size").over(everything) * F.lit(min(budget, most)),
        "caps": F.sum("cap").over(to_here) - F.col("cap"),
        "lighter": F.sum("weight").over(to_here) - F.col("weight"),
        "weights": F.sum("weight").over(everything)})
    # The level if this source is the first that does not fill up; it holds where the source indeed does not.
    level = (F.col("total") - F.col("caps")) / (F.col("weights") - F.col("lighter"))
    levelled = levelled.withColumn("level", F.max(F.when(level <= F.col("full_at"), level)).over(everything))
    share = F.least(F.col("cap"), F.coalesce(F.col("level"), F.col("full_at")) * F.col("weight"))
    n_blocks = F.ceil(F.col("source_size") / F.lit(block_words)).cast("long")
    quota = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("long"),
                                                     F.floor(F.lit(most) * F.col("n_blocks")).cast("long"))).otherwise(0)
    shared = levelled.select("source", "source_size", share.alias("target"), n_blocks.alias("n_blocks")).withColumn("quota", quota)
    running = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return checkpoint(shared.withColumn("first_ticket", F.sum("quota").over(running) - F.col("quota")))


def blocks(measured: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The pieces of documents that make up the blocks: source, block, id, start (of the document), first, words."""
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    cut = measured.where("size > 0").select("id", "source", "size", "start", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * block_words)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    return cut.select("source", "block", "id", "start", (begin - F.col("start")).alias("first"), (end - begin).alias("words"))


def permute(index: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0..n-1: in each round an index and its mirror image swap or not.

    The mirror of x is (k - x) mod n for a pseudorandom k; a hash of the larger of both decides, so
    both decide alike and every round is its own inverse.
    """
    def round_(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(key, r, F.lit("k")), n) - x, n)
        return F.when(F.pmod(F.xxhash64(key, r, F.greatest(x, mirror)), F.lit(2)) == 1, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index, round_)


def slots(target: DataFrame, seed: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The output: shard, slot, source, pass and block of every slot."""
    spark = target.sparkSession
    total = target.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("n")).first()["n"]
    all_slots = spark.range(total).select(
        F.col("id").alias("slot"), F.floor(F.col("id") / shard_slots).alias("shard"),
        F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), F.col("id")), F.lit(max(total, 1))).alias("ticket"))
    # A slot draws a ticket; sources own runs of tickets as long as their quotas. Runs are cut into cells to be joined.
    owners = target.where("quota > 0").select(
        F.col("source"), "first_ticket", "quota", "n_blocks",
        F.explode(F.sequence(F.floor(F.col("first_ticket") / CELL_TICKETS),
                             F.floor((F.col("first_ticket") + F.col("quota") - 1) / CELL_TICKETS))).alias("cell"))
    drawn = (all_slots.withColumn("cell", F.floor(F.col("ticket") / CELL_TICKETS)).join(owners, "cell")
             .where((F.col("ticket") >= F.col("first_ticket")) & (F.col("ticket") < F.col("first_ticket") + F.col("quota")))
             .select("shard", "slot", "source", "quota", "n_blocks"))
    # The counts of a shard are its multinomial draw; k numbers the slots of a source through all shards.
    counts = drawn.groupBy("shard", "source").agg(F.count("*").alias("n"))
    through = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    starts = checkpoint(counts.select(F.col("shard").alias("s_shard"), F.col("source").alias("s_source"), "n",
                                      (F.sum("n").over(through) - F.col("n")).alias("k0")))
    within = Window.partitionBy("shard", "source").orderBy("slot")
    numbered = drawn.withColumn("i", F.row_number().over(within) - 1).join(
        starts.drop("n"), (F.col("shard") == F.col("s_shard")) & F.col("source").eqNullSafe(F.col("s_source")))
    numbered = numbered.select("shard", "slot", "source", "n_blocks", "quota", (F.col("k0") + F.col("i")).alias("k"))

    # Draws above a source's quota go, in order, to the places that other sources still have.
    got = starts.groupBy(F.col("s_source").alias("g_source")).agg(F.sum("n").alias("drawn"))
    balance = target.join(got, F.col("source").eqNullSafe(F.col("g_source")), "left").withColumns(
        {"drawn": F.coalesce("drawn", F.lit(0))}).withColumns(
        {"over": F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)), "short": F.greatest(F.col("quota") - F.col("drawn"), F.lit(0))})
    running = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    balance = balance.withColumns({"over0": F.sum("over").over(running) - F.col("over"),
                                   "short0": F.sum("short").over(running) - F.col("short")})
    places = balance.where("short > 0").select(
        F.col("source").alias("p_source"), F.col("n_blocks").alias("p_blocks"), "drawn", "short0",
        F.explode(F.sequence(F.lit(0), F.col("short") - 1)).alias("j"))
    places = places.select("p_source", "p_blocks", (F.col("drawn") + F.col("j")).alias("p_k"), (F.col("short0") + F.col("j")).alias("turn"))
    surplus = balance.where("over > 0").select(F.col("source").alias("o_source"), "over0")
    moved = (numbered.where("k >= quota").join(surplus, F.col("source").eqNullSafe(F.col("o_source")))
             .select("shard", "slot", (F.col("over0") + F.col("k") - F.col("quota")).alias("turn"))
             .join(places, "turn").select("shard", "slot", F.col("p_source").alias("source"), F.col("p_blocks").alias("n_blocks"), F.col("p_k").alias("k")))
    final = numbered.where("k < quota").select("shard", "slot", "source", "n_blocks", "k").unionByName(moved)
    turn = F.floor(F.col("k") / F.col("n_blocks"))
    return final.select("shard", "slot", "source", turn.alias("pass"), permute(
        F.pmod(F.col("k"), F.col("n_blocks")), F.col("n_blocks"), F.xxhash64(F.lit(seed), F.col("source"), turn)).alias("block"))


def mixed_blocks(measured: DataFrame, target: DataFrame, seed: int = 0, block_words: int = BLOCK_WORDS,
                 shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Every slot of the output with the pieces of documents in it: shard, slot, pass, source, id, start, first, words."""
    taken = slots(target, seed, shard_slots).withColumnsRenamed({"source": "t_source", "block": "t_block"})
    return blocks(measured, block_words).join(
        taken, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("block") == F.col("t_block"))).select(
        "shard", "slot", "pass", "source", "id", "start", "first", "words")


def mix_report(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text",
               weights: Sequence[int] = WEIGHTS, budget: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, source.

    ``taken`` counts the words that the mix takes from the document, repeats counted. Documents
    without words take part with zero. Repeated rows are documents of their own. Other columns are ignored.
    """
    measured = measure(docs, id_column, source_column, text_column, seed=seed)
    target = targets(measured, weights, budget, most)
    taken = mixed_blocks(measured, target, seed).groupBy("source", "start").agg(F.sum("words").alias("taken")).select(
        F.col("source").alias("t_source"), F.col("start").alias("t_start"), "taken")
    # A document with words is known by its source and place; one without shares its place and takes nothing.
    found = measured.where("size > 0").join(
        taken, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("start") == F.col("t_start")), "left").select(
        "id", "source", "size", F.coalesce("taken", F.lit(0)).alias("taken"))
    every = found.unionByName(measured.where("size = 0").select("id", "source", "size", F.lit(0).cast("long").alias("taken")))
    shares = target.select(F.col("source").alias("t_source"), "source_size", "target")
    return every.join(shares, F.col("source").eqNullSafe(F.col("t_source"))).select(
        F.col("id").alias(id_column), "size", "source_size", "target", "taken", F.col("source").alias("source"))


def mix_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """The mix as documents: for each document and pass, a row whose text holds the words taken in it.

    Columns are those of ``documents`` (doc_id, text, lang, source, n_chars). A document taken whole
    keeps its text as it is; one taken in part keeps the words taken, in order, each with the white
    space before it. A document of which nothing is taken is left out, also one without words.
    """
    measured = measure(docs, seed=seed)
    target = targets(measured, weights, budget, most)
    # Rows alike in id, source and text are told apart by a number.
    numbered = measured.where("size > 0").withColumn("copy", F.row_number().over(Window.partitionBy("id", "h").orderBy("start")))
    pieces = mixed_blocks(measured, target, seed).groupBy("source", "start", "pass").agg(
        F.array_sort(F.collect_list(F.struct("first", "words"))).alias("pieces"), F.sum("words").alias("taken")).select(
        F.col("source").alias("t_source"), F.col("start").alias("t_start"), "pieces", "taken")
    chosen = numbered.join(pieces, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("start") == F.col("t_start"))).select(
        F.col("id").alias("c_id"), F.col("h").alias("c_h"), F.col("copy").alias("c_copy"), "size", "taken", "pieces")
    texts = docs.select("doc_id", "text", "lang", "source").withColumn("h", _row_hash(seed, "doc_id", "source", "text"))
    texts = texts.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "h").orderBy(F.lit(0))))
    both = texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("h") == F.col("c_h")) & (F.col("copy") == F.col("c_copy")))
    words = F.regexp_extract_all("text", F.lit(rf"[{SPACE}]*{WORD}"), F.lit(0))
    some = F.array_join(F.flatten(F.transform("pieces", lambda p: F.slice(words, (p["first"] + 1).cast("int"), p["words"].cast("int")))), "")
    return both.select("doc_id", F.when(F.col("taken") == F.col("size"), F.col("text")).otherwise(some).alias("text"),
                       "lang", "source").withColumn("n_chars", F.length("text").cast("long"))
