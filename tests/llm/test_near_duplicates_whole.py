"""Near-duplicates where doc_ids repeat with different texts, and with joins split into parts."""

import random

from test_llm_operators import shingles

from evidencelake.llm import minhash


def brute(rows, percent):
    """Per row (doc_id, text): smallest doc_id that its text reaches."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                common = len(sets[a] & sets[b])
                if common and label[a] != label[b] and 100 * common >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        least[c] = min(i, least.get(c, i))
    return [least[c] for c in label], label


def rows_of(seed):
    rng = random.Random(seed)
    rows = []
    for g in range(25):
        base = [f"g{g}w{i}" for i in range(80)]
        for _ in range(rng.randrange(1, 6)):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(80)] = f"x{rng.random()}"
            rows.append((rng.randrange(30), " ".join(w)))
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    return [*rows, (101, a), (101, b), (102, a + " x"), (103, b + " y"), (101, a), (104, "Few words"), (104, "few words"), (104, "other words")]


def test_repeated_ids_keep_the_links_of_each_text(spark):
    for seed in (1, 2):
        rows = rows_of(seed)
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
        want = sorted((i, len(shingles(t)), c, i == c) for (i, t), c in zip(rows, brute(rows, 85)[0], strict=True))
        assert sorted(map(tuple, got.collect())) == want


def test_keep_first_keeps_one_row_of_each_group(spark):
    rows = [*rows_of(3), (7, ""), (7, None), (8, " ")]
    kept = [tuple(r) for r in minhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()]
    least, group = brute(rows, 80)
    group_of = {r: (g, c) for r, g, c in zip(rows, group, least, strict=True) if shingles(r[1])}
    seen = [group_of[r] for r in kept if r in group_of]
    assert sorted(seen) == sorted(set(group_of.values()))  # each group once
    assert all(i == group_of[i, t][1] for i, t in kept if (i, t) in group_of)
    assert sum(not shingles(t) for _, t in kept) == 3


def test_split_joins_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PART_ROWS", 3)
    rng = random.Random(4)
    base, other = ([f"{c}{i}" for i in range(120)] for c in "st")
    rows = []
    for i in range(60):
        w = list(base if i % 3 else other)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(120)] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    shared = [[f"p{p}_{i}" for i in range(12)] for p in range(20)]  # texts of common paragraphs
    rows += [(100 + i, " ".join(w for p in rng.sample(shared, 14) for w in p)) for i in range(40)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == sorted(zip((i for i, _ in rows), brute(rows, 85)[0], strict=True))
