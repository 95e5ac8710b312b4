"""Inverted index of character n-grams over evidence bodies: a search reads posting lists and the bodies of candidates, not the corpus.

An index is a folder with two tables, to which append() adds a batch, each below batch=N, so that a batch that is appended again
replaces itself. `bodies` has the evidence in order of a document number; `postings` has for each gram and segment of documents the
list of places in the segment of those that hold it, and for each segment, below a gram of its own, its documents and their times,
newest first. A segment is what a task takes at once, SEGMENT_DOCUMENTS or SEGMENT_CHARACTERS at most, so that a place takes two
bytes, no list of a common gram is ever one row, one group or one task, and lists are made without a shuffle of their members.
Both tables are sorted by what is asked for, with small pages, so that Parquet's own statistics leave the rest unread.

Grams are of 1, 2 and 3 characters of the folded body, so a token of any length has some; a longer token is its 3-grams. A search
takes the frequency of its grams, intersects the lists of the rarest and verifies the candidates on their bodies, newest first.
Null and empty bodies are in no list. Evidence ids are unique over all batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencelake.functions import text as X
from evidencelake.operators import search as S

GRAM = 3
#: Stands for a character that a gram of fewer than three doesn't have; no code point is as large.
NONE = 0x1FFFFF
#: Stands where a gram would, in the row that lists a segment's documents.
LISTED = -1
SEGMENT_DOCUMENTS, SEGMENT_CHARACTERS = 4096, 1 << 23
#: Grams whose lists are intersected; documents whose bodies are asked for by number before the others are joined.
RAREST, FIRST = 6, 128
PAGE_ROWS = 8


def grams_of(characters: np.ndarray) -> np.ndarray:
    """Distinct grams of code points, as numbers of three times 21 bits."""
    c = characters.astype(np.int64)
    parts = [c << 42 | NONE << 21 | NONE]
    if len(c) > 1:
        parts.append(c[:-1] << 42 | c[1:] << 21 | NONE)
    if len(c) > 2:
        parts.append(c[:-2] << 42 | c[1:-1] << 21 | c[2:])
    return np.unique(np.concatenate(parts))


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def token_grams(token: str) -> list[int]:
    """The grams that a body which holds the token has to have: all 3-grams, or the token itself if it is shorter."""
    c = _code_points(token).astype(np.int64)
    if len(c) >= GRAM:
        return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]).tolist()
    return [int(c[0] << 42 | (c[1] if len(c) > 1 else NONE) << 21 | NONE)]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each segment of (doc, at, folded): one with its documents, newest first, and one per gram with the places there of those that hold it."""
    kept: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def lists() -> pa.RecordBatch:
        kept.sort(key=lambda x: (-x[1], x[0]))
        gram = np.concatenate([g for _, _, g in kept])
        which = np.repeat(np.arange(len(kept)), [len(g) for _, _, g in kept])
        order = np.argsort(gram, kind="stable")
        gram, which = gram[order], which[order]
        starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        n = np.diff(np.r_[starts, len(gram)])
        first = kept[0][0]  # no other segment has this document
        none = pa.nulls(len(n), pa.list_(pa.int64()))
        columns = {
            "gram": pa.array(np.r_[LISTED, gram[starts]]), "n": pa.array(np.r_[len(kept), n], pa.int32()), "segment": pa.array(np.full(len(n) + 1, first)),
            "places": pa.concat_arrays([pa.nulls(1, pa.list_(pa.int16())), pa.ListArray.from_arrays(pa.array(np.r_[starts, len(gram)], pa.int32()), pa.array(which.astype(np.int16)))]),
            "at": pa.concat_arrays([pa.array([[a for _, a, _ in kept]], pa.list_(pa.int64())), none]), "docs": pa.concat_arrays([pa.array([[d for d, _, _ in kept]], pa.list_(pa.int64())), none]),
        }
        return pa.record_batch(columns)

    for batch in batches:
        for doc, at, folded in zip(batch.column("doc").to_pylist(), batch.column("at").to_pylist(), batch.column("folded").to_pylist(), strict=True):
            kept.append((doc, at, grams_of(_code_points(folded))))
            size += len(folded)
            if len(kept) == SEGMENT_DOCUMENTS or size > SEGMENT_CHARACTERS:
                yield lists()
                kept, size = [], 0
    if kept:
        yield lists()


def _instant(evidence: DataFrame) -> Column:
    """created_at as a number that sorts as it does."""
    kind = evidence.schema["created_at"].dataType.typeName()
    at = F.unix_micros(F.col("created_at").cast("timestamp")) if kind.startswith(("timestamp", "date")) else F.col("created_at").cast("long")
    return F.coalesce(at, F.lit(-(1 << 63)))


def _pages(rows: int) -> dict[str, int]:
    """Options of a table that is read at single places: pages of so many rows, whose statistics the scan skips by."""
    return {"parquet.page.row.count.limit": rows, "parquet.page.size.row.check.min": rows, "parquet.block.size": 1 << 24}


def append(evidence: DataFrame, root: str, batch: int) -> None:
    """Add evidence (evidence_id, markdown, meta_title, created_at) to the index as the given batch."""
    spark = evidence.sparkSession
    bodies = evidence.select("evidence_id", "meta_title", "created_at", _instant(evidence).alias("at"), X.body_prefix(F.col("markdown")).alias("body")).where("length(body) > 0")
    path = f"{root}/bodies/batch={batch}"
    # The number is made as the rows are written, once; what is read back has it fixed.
    bodies.withColumn("doc", F.monotonically_increasing_id()).write.mode("overwrite").options(**_pages(PAGE_ROWS)).parquet(path)
    rows = spark.read.parquet(path).select("doc", "at", X.fold(F.col("body")).alias("folded"))
    postings = rows.mapInArrow(_segments, "gram long, n int, segment long, places array<smallint>, at array<bigint>, docs array<bigint>")
    # Ranges of (gram, segment): a gram of many segments is cut too.
    ordered = postings.repartitionByRange(F.col("gram"), F.col("segment")).sortWithinPartitions("gram")
    ordered.write.mode("overwrite").options(**_pages(128)).parquet(f"{root}/postings/batch={batch}")


def _any_of(name: str, values: list[int]) -> Column:
    """name is one of values, as a balanced tree of equalities, which the scan takes as it is; a long IN would come as a mere range."""
    level = [F.col(name) == v for v in values]
    while len(level) > 1:
        level = [reduce(lambda a, b: a | b, level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0]


def candidates(spark: SparkSession, root: str, asked: list[str]) -> DataFrame:
    """(batch, doc, at) of the documents that have the rarest grams of all tokens; no other document can hold them."""
    wanted = sorted({g for t in asked for g in token_grams(t)})
    postings = spark.read.parquet(f"{root}/postings")
    found = dict(tuple(r) for r in postings.where(F.col("gram").isin(wanted) if len(wanted) > 200 else _any_of("gram", wanted)).groupBy("gram").agg(F.sum("n")).collect())  # a row per gram of the query
    if len(found) < len(wanted):
        return spark.createDataFrame([], "batch int, doc bigint, at bigint")
    rarest = sorted(found, key=lambda g: (found[g], g))[:RAREST]
    # A segment has one list per gram at most, so those that hold all grams are met list by list.
    lists = postings.where(_any_of("gram", rarest)).groupBy("batch", "segment").agg(F.collect_list("places").alias("l")).where(F.size("l") == len(rarest))
    places = F.aggregate(F.slice("l", 2, RAREST), F.get("l", F.lit(0)), F.array_intersect)
    met = lists.select("batch", "segment", places.alias("places")).where(F.size("places") > 0)
    listed = postings.where(F.col("gram") == LISTED).select("batch", "segment", "docs", "at")
    each = met.join(listed, ["batch", "segment"]).select("batch", F.explode(F.transform("places", lambda p: F.struct(F.get("docs", p).alias("doc"), F.get("at", p).alias("at")))).alias("p"))
    return each.select("batch", "p.doc", "p.at")


def search(spark: SparkSession, root: str, query: str, limit: int = 30) -> DataFrame:
    """search.search() over the index: the same rows, from posting lists and bodies of candidates.

    The newest FIRST candidates are fetched by their numbers; if they hold fewer hits than asked for, the others are joined too.
    """
    asked = S.parse(query)
    if not asked:
        raise ValueError("a query is needed")
    limit = min(max(limit, 1), S.MAX_RESULTS)
    bodies = spark.read.parquet(f"{root}/bodies").withColumnRenamed("body", "_body")
    wanted = candidates(spark, root, asked)
    first = wanted.orderBy(F.desc("at"), "batch", "doc").limit(FIRST).collect()  # FIRST rows at most

    def hits(d: DataFrame) -> DataFrame:
        return d.withColumn("_folded", X.fold(F.col("_body"))).where(S._holds(F.col("_folded"), asked))

    def fetched(rows: list) -> DataFrame:
        by: dict[int, list[int]] = {}
        for r in rows:
            by.setdefault(r["batch"], []).append(r["doc"])
        parts = [bodies.where((F.col("batch") == b) & _any_of("doc", sorted(docs))) for b, docs in by.items()]
        return reduce(DataFrame.unionByName, parts) if parts else bodies.where("false")

    found = hits(fetched(first))
    if len(first) == FIRST:
        oldest = first[-1]["at"]
        # Hits at least as new as the oldest one fetched stand before all others; ties with it are only told apart by all of them.
        if found.where(F.col("at") > oldest).limit(limit).count() < limit:
            found = hits(bodies.join(wanted.select("batch", "doc"), ["batch", "doc"], "left_semi"))
    top = found.orderBy(F.desc("created_at"), "evidence_id").limit(limit)
    return S._shown(top, F.lit(asked[0])).select("evidence_id", "title", "snippet", "created_at")
