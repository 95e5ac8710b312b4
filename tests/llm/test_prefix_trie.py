"""The trie against plain Python: nulls, ties, repeated turns, absent lenders, conversations over a block, end lists over a chunk."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from evidencelake.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, rep string"


def brute(rows, family=20, heads=4):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    for c in own:
        own[c].sort()
    whole = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)
        whole[c] = tuple((t[2], t[4]) for t in own.get(base, [])[:h] + mine[h:])
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, s in whole.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            nodes[s[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in nodes:
        if k:
            children[k[:-1]] += 1
    for k, m in nodes.items():
        w = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(m) - 1) * w
    return [(min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), children.get(k, 0), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()) for k, m in nodes.items()]


def same(spark, rows):
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(rows)))


def test_equals_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for c in [*range(-5, 90), 200, 201, 219, 341]:
        for t in range(rnd.choice([1, 1, 2, 3, 6])):
            rows.append((c, rnd.choice([None, t, t, 1]), rnd.choice(["user", "user", None, ""]), rnd.choice(["a b", "a\tb c", None, "", "é f"]), 1, "x"))
    rows += rows[:9] + [(None, 0, "user", "nobody", 1, "x")] * 3
    same(spark, rows)


def test_long_conversations_and_many_equal_ones(spark):
    rows = [(1_000_000 + c, t, "r", f"w{t} {'z' * (t % 3)}", 0, "") for c in (0, 1, 2) for t in range(2600 + c)]
    rows += [(20 * c, 0, "r", "w0 ", 0, "") for c in range(4300)]
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))
    want = {(w[0], w[1]): w for w in brute_quick(rows)}
    have = {(g["conv_id"], g["depth"]): tuple(g) for g in got.collect()}
    assert have == want


def brute_quick(rows):
    """As brute(), for few deep paths: suffix sums instead of walks."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        own[c].append((turn, role, text))
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(t[1:] for t in sorted(own.get(c - c % 20, []))[:h] + sorted(own[c])[h:])
    members, ends, children, leaves, saved, key = defaultdict(list), defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int), {}
    for c, s in whole.items():
        running = hashlib.sha256()
        keys = [running.hexdigest()]
        for t in s:
            running.update(repr(t).encode())
            keys.append(running.hexdigest())
        for d, k in enumerate(keys):
            members[k].append(c)
            key[k] = (d, keys[d - 1] if d else None, len(s[d - 1][1].split()) if d else 0)
        ends[keys[-1]].append(c)
    for k in sorted(key, key=lambda k: -key[k][0]):
        d, up, w = key[k]
        leaves[k] = leaves[k] or 1
        saved[k] += (len(members[k]) - 1) * w
        if up:
            children[up] += 1
            leaves[up] += leaves[k]
            saved[up] += saved[k]
    return [(min(m), key[k][0], min(members[key[k][1]]) if key[k][1] else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items()]


def test_empty_table_and_one_turnless_conversation(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    same(spark, [(c, 0, "r", "t", 0, "")])
