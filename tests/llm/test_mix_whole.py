"""The mix against a plain version of it: per document what is taken and in which slots; and the order that the pipeline writes."""

import collections
import math

import pytest
from test_llm_operators import SF, WORD, brute_targets, documents, needs_tables, odd_rows

from evidencelake.llm import mixing


def brute_mix(rows, order, block):
    """(doc_id, text, source) -> list of (taken, slots) per row, from the rows in their sources' shuffled order."""
    sizes, names = collections.Counter(), []
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    quota = {s: int(t + 1e-6) for s, t in brute_targets(sizes).items()}
    blocks = {s: math.ceil(quota[s] / block) for s in names}
    total, slot_of, dealt = sum(blocks.values()), {}, collections.Counter()
    upper, run = {}, 0
    for s in names:
        run += blocks[s]
        upper[s] = run / total if total else 0
    for slot in range(total):
        point = slot * mixing.GOLDEN % 1.0
        s = next((x for x in names if blocks[x] and upper[x] > point), [x for x in names if blocks[x]][-1])
        if dealt[s] < blocks[s]:
            slot_of[s, dealt[s]] = slot
        dealt[s] += 1
    for s in names:
        for b in range(min(dealt[s], blocks[s]), blocks[s]):
            slot_of[s, b] = total
    out, passes = collections.defaultdict(list), []
    for s in names:
        at = 0
        for row in (r for r in order if r[2] == s):
            n = len(WORD.findall(row[1] or ""))
            taken, slots = 0, set()
            for again in (0, 1):
                begin = at + again * sizes[s]
                words = range(begin, min(begin + n, quota[s]))
                taken += len(words)
                mine = {slot_of[s, w // block] for w in words}
                slots |= mine
                if mine:
                    passes.append((min(mine), row))
            out[row].append((taken, min(slots, default=None), len(slots)))
            at += n
    return out, [r for _, r in sorted(passes, key=lambda p: p[0])], [p for p, _ in sorted(passes, key=lambda p: p[0])]


@needs_tables
@pytest.mark.parametrize("block", [7, 100, 1024])
def test_taken_words_and_slots_per_document(spark, block):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    placed, _ = mixing.mix_pieces(docs, block_words=block)
    order = [(r["doc_id"], text[r["doc_id"]], r["source"]) for r in sorted(placed.collect(), key=lambda r: (str(r["source"]), r["start"], r["size"]))]
    want, passes, slots = brute_mix(order, order, block)
    got = mixing.mix(docs, block_words=block).collect()
    assert len(got) == len(order)
    for r in got:
        assert [(r["taken"], r["first_slot"], r["n_slots"])] == want[r["doc_id"], text[r["doc_id"]], r["source"]]
    assert len({r["first_slot"] for r in got}) > 3

    rows = mixing.mixed_rows(docs, block_words=block).collect()
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(i for i, *_ in passes)
    by_slot = {}
    for p, (i, *_) in zip(slots, passes, strict=True):
        by_slot.setdefault(i, []).append(p)
    seen, written = collections.Counter(), []
    for r in rows:
        written.append(by_slot[r["doc_id"]][seen[r["doc_id"]]])
        seen[r["doc_id"]] += 1
    assert written == sorted(written)  # the mix's order, not the sources'


def test_rows_of_the_mix_on_odd_rows(spark):
    docs = documents(spark, [*odd_rows(), (None, "words of a row without id", "en", "a")])
    rows = mixing.mixed_rows(docs, block_words=16)
    assert rows.columns == docs.columns and rows.count() > 0
    assert mixing.mixed_rows(docs.limit(0)).count() == 0
