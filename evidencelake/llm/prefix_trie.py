"""Prefix trie of conversations by whole-sequence collapse: equal conversations are one weighted sequence, and prefixes of sequences are summed.

A turn travels as a 128-bit hash of its role and text and its number of words; a prefix is the XOR of the hashes of its (place, turn)
pairs, two times 64 bits, so that prefixes are running values which cross the blocks of a long conversation. No conversation, no
group of equal ones and no node's members are ever one task's or one row's, but for the SHA-256 of an end list, which by its nature
is taken in order: its list comes as joined chunks of 4,096 numbers, which tasks make in parallel, and is hashed as it streams by.

Sums over subtrees need no walk: the members' own turns from a depth on give the first part of saved_tokens, and a sequence's turns
that it alone (having the smallest conv_id) stands for give the second, as they are the end of its path.

Nulls: null turns come first, null roles and texts are empty, rows without conv_id are no conversation. Turns that tie are ordered by
role and then by the text's SHA-256; repeated rows are turns of their own. An empty table has no node. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.llm.common import materialize, n_words
from evidencelake.operators.ordered import numbered

#: Turns whose running values are taken in one window; conv_ids that are joined into one chunk of an end list.
BLOCK = 1024
CHUNK = 4096
#: Lanes of a prefix's hash, and their salts.
LANES = {"_x": 11, "_y": 23}


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, token, n) of every turn: its place (from 1) in its conversation, the hash of its role and text, and words."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    slim = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.sha2(text, 256).alias("digest"), n_words(text).alias("n"))
    placed = numbered(slim, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")], "place")
    return placed.select("conv_id", (F.col("place") + 1).alias("place"), F.sha2(F.concat_ws(":", F.octet_length("role"), "role", "digest"), 256).alias("token"), "n")


def rebuilt(own: DataFrame, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of all conversations, and the turns (conv_id, place, token, n) of the rebuilt ones.

    The first h = crc32(conv_id) % heads turns come from the conversation conv_id - conv_id % family, the rest are the conversation's
    own after its first h. So a turn is lent to at most `family` conversations.
    """
    h, base_of = F.crc32(F.col("conv_id").cast("string")) % heads, F.col("conv_id") - F.col("conv_id") % family
    each = own.groupBy("conv_id").agg(F.count("*").alias("size")).withColumns({"h": h, "base": base_of})
    lenders = each.where("base = conv_id").select("base", F.col("size").alias("base_size"))
    each = materialize(each.join(lenders, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_size", F.lit(0).cast("long"))).alias("taken")), "trie-conversations")
    first = own.where(F.col("place") < heads).select(F.col("conv_id").alias("base"), "place", "token", "n")
    borrowed = each.where("taken > 0").join(first, "base").where("place <= taken").select("conv_id", "place", "token", "n")
    rest = own.join(each.select("conv_id", "h", "taken"), "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "token", "n")
    return each.select("conv_id"), borrowed.unionByName(rest)


def _lane(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), "place", "token")


def _running(rows: DataFrame) -> DataFrame:
    """rows with each prefix's lanes and words so far, in blocks whose sums are carried on."""
    block = F.expr(f"(place - 1) div {BLOCK}")
    w = Window.partitionBy("conv_id", "_block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    d = rows.withColumns({"_block": block, **{c: _lane(s) for c, s in LANES.items()}})
    sums = d.groupBy("conv_id", "_block").agg(*(F.bit_xor(c).alias(f"{c}b") for c in LANES), F.sum("n").alias("_nb"))
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # Only conversations of over a block have anything to carry; the window runs over blocks, not turns.
    long = d.where("_block > 0").select("conv_id").distinct()
    carried = sums.join(long, "conv_id", "left_semi").select("conv_id", "_block", *(F.bit_xor(f"{c}b").over(before).alias(f"{c}b") for c in LANES), F.sum("_nb").over(before).alias("_nb"))
    d = d.withColumns({**{c: F.bit_xor(c).over(w) for c in LANES}, "upto": F.sum("n").over(w)}).join(carried, ["conv_id", "_block"], "left")
    return d.withColumns({**{c: F.col(c).bitwiseXOR(F.coalesce(f"{c}b", F.lit(0).cast("long"))) for c in LANES}, "upto": F.col("upto") + F.coalesce("_nb", F.lit(0))}).drop("_block", "_nb", *(f"{c}b" for c in LANES))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rep, conv_id) in order become (rep, first, joined): at most CHUNK numbers of one list a row."""
    rep, ids = None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"rep": pa.array([rep], pa.int64()), "first": pa.array([ids[0]], pa.int64()), "joined": [",".join(map(str, ids))]})

    for batch in batches:
        for r, c in zip(batch.column("rep").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (r != rep or len(ids) == CHUNK):
                yield out()
                ids = []
            rep = r
            ids.append(c)
    if ids:
        yield out()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in order of (rep, first) become (rep, ends_sha256), one running hash at a time."""
    rep, running = None, None
    for batch in batches:
        reps, digests = [], []
        for r, joined in zip(batch.column("rep").to_pylist(), batch.column("joined").to_pylist(), strict=True):
            if running is not None and r == rep:
                running.update(b"," + joined.encode())
                continue
            if running is not None:
                reps.append(rep)
                digests.append(running.hexdigest())
            rep, running = r, hashlib.sha256(joined.encode())
        yield pa.RecordBatch.from_pydict({"rep": pa.array(reps, pa.int64()), "ends_sha256": pa.array(digests, pa.string())})
    if running is not None:
        yield pa.RecordBatch.from_pydict({"rep": pa.array([rep], pa.int64()), "ends_sha256": pa.array([running.hexdigest()], pa.string())})


def end_lists(members: DataFrame) -> DataFrame:
    """(rep, ends_sha256) of members (rep, conv_id): the SHA-256 of each sequence's conv_ids, ascending, joined by commas."""
    alone = members.groupBy("rep").agg(F.count("*").alias("_n"))
    single = alone.where("_n = 1").select("rep", F.sha2(F.col("rep").cast("string"), 256).alias("ends_sha256"))  # a list of one is its representative
    many = members.join(alone.where("_n > 1"), "rep", "left_semi")
    ranges = many.repartitionByRange(F.col("rep"), F.col("conv_id")).sortWithinPartitions("rep", "conv_id")
    chunks = materialize(ranges.mapInArrow(_chunks, "rep long, first long, joined string"), "trie-ends")
    hashed = chunks.repartition(F.col("rep")).sortWithinPartitions("rep", "first").mapInArrow(_hashed, "rep long, ends_sha256 string")
    return single.unionByName(hashed)


def trie(conversations: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    A node is told by its smallest conversation and its depth, and within the job by its prefix's hash and depth.
    """
    every, rows = rebuilt(turns(conversations), family, heads)
    rows, zero, node = materialize(rows, "trie-turns"), F.lit(0).cast("long"), [*LANES, "depth"]
    # Whole-sequence collapse: equal rebuilt conversations are one sequence, named by its smallest conv_id.
    whole = rows.groupBy("conv_id").agg(*(F.bit_xor(_lane(s)).alias(c) for c, s in LANES.items()), F.count("*").alias("depth"), F.sum("n").alias("words"))
    whole = materialize(every.join(whole, "conv_id", "left").select("conv_id", *(F.coalesce(c, zero).alias(c) for c in (*node, "words"))), "trie-whole")
    sequences = materialize(whole.groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.max("words").alias("words")), "trie-sequences")
    members = whole.join(sequences.select(*node, F.col("conv_id").alias("rep")), node).select("rep", "conv_id")
    ends = sequences.join(end_lists(members).withColumnRenamed("rep", "conv_id"), "conv_id").select(*node, "ends_sha256")
    # The sequences' prefixes, the root among them, each with the words of its path from there on.
    steps = _running(rows.join(sequences.select("conv_id"), "conv_id", "left_semi")).withColumnRenamed("place", "depth").select("conv_id", *node, "n", "upto")
    own = sequences.select("conv_id", "weight", "words", F.col("depth").alias("whole"))
    root = own.select("conv_id", *(zero.alias(c) for c in (*node, "n", "upto")), "weight", "words", "whole")
    paths = materialize(steps.join(own, "conv_id").unionByName(root).withColumn("rest", F.expr("words - upto + n")).drop("n", "upto", "words"), "trie-paths")
    # Leaves: sequences that are no proper prefix of another.
    leaves = sequences.join(paths.where("depth < whole").select(*node).distinct(), node, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    nodes = paths.join(leaves, "conv_id", "left").groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count("leaf").alias("n_leaves"), F.sum(F.expr("weight * rest")).alias("said"))
    nodes = materialize(nodes, "trie-nodes")
    # A sequence stands for the nodes of which it is the smallest, from depth `top` to its end; there its words count once.
    tops = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"))
    owned = materialize(paths.join(tops, "conv_id").drop("weight", "whole"), "trie-owned")
    tail = owned.where("depth = top").select("conv_id", F.col("rest").alias("tail"))
    once = owned.join(tail, "conv_id").groupBy(*node).agg(F.sum(F.when(F.col("depth") >= F.col("top"), F.col("rest")).otherwise(F.col("tail"))).alias("once"))
    # Below its top a sequence is its nodes' parent too; the top's own parent is met by hash, that of depth 1 is the root.
    first = nodes.where("depth = 0").select("conv_id").first()
    lifted = owned.where("depth = top - 1 and depth > 0").select("conv_id", *node)
    lifted = lifted.join(nodes.select(*node, F.col("conv_id").alias("parent")), node).select("conv_id", (F.col("depth") + 1).alias("depth"), "parent")
    placed = nodes.join(lifted, ["conv_id", "depth"], "left").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(first[0] if first else None).cast("long")).when(F.col("depth") > 1, F.coalesce("parent", "conv_id")))
    placed = materialize(placed.drop("parent"), "trie-placed")
    children = placed.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    return placed.join(children, ["conv_id", "depth"], "left").join(once, node).join(ends, node, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
        F.expr("said - once").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
