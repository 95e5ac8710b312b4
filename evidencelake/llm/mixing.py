"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Each source's documents are put in a seeded-shuffled order; their words form one stream, which is read up to twice and is
cut into blocks of equal numbers of words. The points frac(i * golden ratio) pass through the cumulative shares of the
targets and so deal the mix's slots to sources; the r-th slot of a source takes its r-th block. A source's last block is
as long as its target leaves, so that what it gives is its target, rounded down.

Slots decide where in the mix a document's words stand (first_slot, n_slots; mixed_rows writes rows in that order); blocks
decide how many of them are taken. The schedule has a row per block of the mix and is a table of its own, so that a join with
it is broadcast only where its measured size is small.

Positions in a stream are prefix sums in two steps (per hash bucket, then within it), so that a source with a third of all
rows is spread over all tasks; the number of buckets follows the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.llm.common import hash_bits, materialize, n_words, running_offsets

GOLDEN = 0.6180339887498949
SLOT_RUN = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share_percent: int, most_times: int) -> DataFrame:
    """(source, source_size, target) from (source, size): weights go round the sources by code point order, null last.

    The total (share_percent of all sizes) is dealt by weight; a target stops at most_times its source's size and the excess
    goes on by weight. That is one level l with target = min(cap, l * weight): sources are ordered by cap / weight, and the
    first one that its share of what is left doesn't fill sets the level. One row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(w) for w in weights))
    w = per.withColumn("source_rank", F.row_number().over(by_name) - 1)
    w = w.withColumn("weight", F.element_at(cycle, (F.col("source_rank") % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", most_times * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy("ratio", "source_rank")
    every = Window.partitionBy(F.lit(0))
    w = w.withColumn("total", F.sum("source_size").over(every) * share_percent / 100.0)
    w = w.withColumn("caps_before", F.sum("cap").over(by_ratio) - F.col("cap"))
    w = w.withColumn("weight_left", F.sum("weight").over(every) - F.sum("weight").over(by_ratio) + F.col("weight"))
    w = w.withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("weight_left"))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every)
    w = w.withColumn("level", level)
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce("level", F.lit(float("inf"))))
    return w.select("source", "source_rank", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """(slot, source_rank, block): the mix's slots in order. Sources that the sequence leaves short by a few slots get them at its end."""
    need = F.ceil(F.floor("target") / F.lit(block_words)).cast("long")
    t = targets.select("source_rank", need.alias("blocks"))
    every = Window.partitionBy(F.lit(0))
    ordered = every.orderBy("source_rank")
    t = t.withColumn("total", F.sum("blocks").over(every)).where("blocks > 0")
    t = t.withColumn("upper", F.sum("blocks").over(ordered) / F.col("total"))
    spark = targets.sparkSession
    runs = t.agg(F.max("total").alias("n")).select("n", F.explode(F.sequence(F.lit(0), F.floor((F.coalesce("n", F.lit(0)) - 1) / SLOT_RUN).cast("long"))).alias("run"))
    runs = runs.where("n > 0").repartition(spark.sparkContext.defaultParallelism * 2, "run")
    slots = runs.select("run", F.explode(F.sequence(F.col("run") * SLOT_RUN, F.least(F.col("n"), (F.col("run") + 1) * SLOT_RUN) - 1)).alias("slot"))
    cuts = t.agg(F.sort_array(F.collect_list(F.struct("upper", "source_rank", "blocks"))).alias("cuts"))
    dealt = materialize(_deal(slots, cuts), "schedule")
    before = running_offsets(dealt, ["source_rank"], "run", F.lit(1), "dealt", "before")
    ranked = dealt.join(before, ["source_rank", "run"])
    own = Window.partitionBy("source_rank", "run").orderBy("slot")
    ranked = ranked.withColumn("block", F.col("before") + F.row_number().over(own) - 1).where("block < blocks")
    filled = t.join(before.groupBy("source_rank").agg(F.max("dealt").alias("dealt")), "source_rank", "left").withColumn("dealt", F.coalesce("dealt", F.lit(0)))
    short = filled.where("dealt < blocks").select(F.col("total").alias("slot"), "source_rank", F.explode(F.sequence(F.col("dealt"), F.col("blocks") - 1)).alias("block"))
    return ranked.select("slot", "source_rank", "block").unionByName(short)


def _deal(slots: DataFrame, cuts: DataFrame) -> DataFrame:
    """The source of each slot: the first cumulative share above its point. The cuts are one row with an entry per source."""
    c = slots.withColumn("mix", F.lit(1)).join(cuts.withColumn("mix", F.lit(1)), "mix")
    point = F.col("slot") * GOLDEN % 1.0
    hit = F.filter("cuts", lambda x: x["upper"] > point)
    hit = F.when(F.size(hit) > 0, hit[0]).otherwise(F.element_at("cuts", -1))
    return c.withColumn("hit", hit).select("run", "slot", F.col("hit.source_rank").alias("source_rank"), F.col("hit.blocks").alias("blocks"))


def _streams(sized: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Rows with words, each with the place where its words begin in its source's shuffled stream."""
    names = targets.select(F.col("source").alias("_s"), "source_rank", "source_size", "target")
    d = sized.join(names, sized.source.eqNullSafe(names._s), "left").drop("_s")
    d = d.withColumn("shuffle", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.shiftrightunsigned("shuffle", 64 - hash_bits(sized.count())).cast("int"))
    offsets = running_offsets(d, ["source_rank"], "bucket", F.col("size"), "_total", "before").drop("_total")
    ties = [c for c in ("tie", "row") if c in d.columns]
    place = Window.partitionBy("source_rank", "bucket").orderBy("shuffle", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.join(offsets, ["source_rank", "bucket"])
    return d.withColumn("start", F.col("before") + F.sum("size").over(place) - F.col("size")).drop("before", "bucket", "shuffle")


def sized_documents(docs: DataFrame, size: Column | None = None, row: str | None = None) -> DataFrame:
    """With row, the name of a column that tells rows apart: also row, and tie, a hash of the other columns."""
    by = [] if row is None else [F.col(row).alias("row"), F.xxhash64(*(F.col(c) for c, t in docs.dtypes if c != row and "map<" not in t)).alias("tie")]
    return docs.select("doc_id", "source", (n_words(F.col("text")) if size is None else size).alias("size"), *by)


def mix_pieces(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share_percent: int = 150, most_times: int = 2, block_words: int = 1024, seed: int = 17, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces): every row of docs with its place and its source's target, and the pieces of documents in slot order.

    documents: doc_id, source, size, source_rank, source_size, target, start. pieces: slot, source_rank, block, doc_id,
    start, first (word of the document), words, repetition (0 or 1).
    """
    sized = materialize(sized_documents(docs, row=row), "sizes")
    targets = materialize(source_targets(sized, weights, share_percent, most_times), "targets", 1)
    placed = materialize(_streams(sized, targets, seed), "streams")
    quota = F.floor("target").cast("long")
    reads = placed.where("size > 0").select("doc_id", "source_rank", "start", "size", "target", F.explode(F.sequence(F.lit(0), F.lit(most_times - 1))).alias("repetition"), "source_size")
    reads = reads.withColumn("begin", F.col("start") + F.col("repetition") * F.col("source_size")).withColumn("end", F.least(F.col("begin") + F.col("size"), quota)).where("end > begin")
    cut = reads.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block_words), F.floor((F.col("end") - 1) / block_words))))
    low, high = F.greatest("begin", F.col("block") * block_words), F.least("end", (F.col("block") + 1) * block_words)
    pieces = cut.select("source_rank", "block", "doc_id", "start", "repetition", (low - F.col("begin")).alias("first"), (high - low).alias("words"))
    return placed, schedule(targets, block_words).join(pieces, ["source_rank", "block"])


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_slot, n_slots for every row of docs (doc_id, source, text).

    first_slot and n_slots: the mix's slots that take words of the row; null and 0 where none do. Null and empty texts have
    size 0 and are never taken; null sources are a source of their own; repeated rows are told apart by their places in the
    stream. Reruns agree: order depends on ids alone. An empty table gives an empty result.

    With the option row, the name of a column that tells rows apart, the result has it as `row`, and rows of one doc_id and
    size (or without doc_id) are ordered by a hash of their other columns, so that reruns take the same texts.
    """
    placed, pieces = mix_pieces(docs, **options)
    taken = pieces.groupBy("source_rank", "start").agg(F.sum("words").cast("long").alias("taken"), F.min("slot").alias("first_slot"), F.count_distinct("slot").alias("n_slots"))
    sized = placed.where("size > 0").join(taken, ["source_rank", "start"], "left")
    out = sized.unionByName(placed.where("size = 0"), allowMissingColumns=True)
    own = ["row"] if options.get("row") else []
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "source", "size", "source_size", "target", none("taken"), "first_slot", none("n_slots"), *own)


def mixed_rows(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of docs that the mix takes, in the order of its slots, once for each pass over their source in which it takes words of them.

    Rows get a key of their own and are kept as a table with it, so that null and repeated doc_ids come back as the rows they
    are. The columns are those of docs. An empty table gives an empty result.
    """
    rows = materialize(docs.withColumn("_mix_row", F.monotonically_increasing_id()), "mix-rows")
    placed, pieces = mix_pieces(rows, row="_mix_row", **options)
    passes = pieces.groupBy("source_rank", "start", "repetition").agg(F.min("slot").alias("_mix_slot"))
    taken = placed.where("size > 0").join(passes, ["source_rank", "start"]).select(F.col("row").alias("_mix_row"), "_mix_slot", F.col("start").alias("_mix_start"))
    taken = materialize(taken, "passes")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = taken.agg(F.max("_mix_slot")).first()[0] or 0
    # Slots are even in words, so equal stretches of slots are equal parts; no sample of the texts is needed to find them.
    part = F.floor(F.col("_mix_slot") * parts / (last + 1)).cast("int")
    return rows.join(taken, "_mix_row").repartitionById(parts, part).sortWithinPartitions("_mix_slot", "_mix_start").select(docs.columns)


__all__ = ["mix", "mixed_rows", "mix_pieces", "source_targets", "schedule"]
