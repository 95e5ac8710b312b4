"""Merkle manifest of a dataset: a tree of SHA-256 digests per language, one tree over their roots, in blocks of subtrees.

Every parent retains the hash state before each of its child slots, as bytes. Folding a changed leaf resumes the state of its slot
with the replacement and takes the right siblings only; the left ones are in the state already.

The tree is cut into blocks of up to 4,096 children (for a fan of 2: 12 levels). A block is one group, so that a language with a third
of all rows is many tasks, and the number of Spark stages grows with the logarithm to the base 4,096 of the rows. A row of the manifest
is a block: `nodes` has its digests level by level from the children up, 32 bytes each, `states` the midstates of its parents in the
same order, `fan` of them each.

Nulls: a null language is a tree of its own, before all others; a null doc_id comes first in its tree and is never tampered with; null
fields are `-` in the leaf. Repeated rows are leaves of their own; rows with equal doc_id are ordered by their leaves. Texts are hashed
whole. An empty table has no rows and no root. Columns besides doc_id, source, lang, n_chars and text play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencelake.llm import sha256 as S
from evidencelake.llm.common import materialize
from evidencelake.operators.ordered import numbered

#: Children of a block, at most.
BLOCK = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
MANIFEST = "tier int, tree string, block long, n int, levels int, nodes binary, states binary, digest binary"
_CONTEXT = "tree string, block long, path binary, subroot binary, root binary"


def leaf(**replaced: Column) -> Column:
    """Digest of a row's fields, each `-` if null, else its bytes, a colon and itself."""
    fields = [replaced.get(c, F.col(c)).cast("string") for c in FIELDS]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in fields)), 256))


def tree_of(lang: Column) -> Column:
    """A name for the tree of a language that sorts as the language does, null before all."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit("-"))


def _levels(fan: int, most: int) -> int:
    """Levels of a full block of at most so many children."""
    n, k = fan, 1
    while n * fan <= most:
        n, k = n * fan, k + 1
    return k


def _sizes(n: int, levels: int, fan: int) -> list[int]:
    out = [n]
    for _ in range(levels):
        out.append(-(-out[-1] // fan))
    return out


def _grow(digests: np.ndarray, levels: int, fan: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Digests of each level, children first, and the midstates (parents, fan, 32) of each level of parents."""
    nodes, states = [digests], []
    for _ in range(levels):
        below = nodes[-1]
        parents = -(-len(below) // fan)
        state, kept = S.start(parents), np.zeros((parents, fan, 32), np.uint8)
        up = np.zeros((parents, 32), np.uint8)
        for slot in range(fan):
            have = len(range(slot, len(below), fan))  # parents with a child in this slot
            kept[:have, slot] = S.unpack(state[:, :have])
            state = S.compress(state[:, :have], S.hex_block(below[slot::fan]))
            ends = np.arange(have) if slot == fan - 1 else np.arange(have - 1, have) if (have - 1) * fan + slot == len(below) - 1 else np.zeros(0, int)
            if len(ends):
                up[ends] = S.finish(state[:, ends], slot + 1)
        nodes.append(up)
        states.append(kept)
    return nodes, states


def _build(fan: int, full: int, tier: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        tree, block = (k.as_py() for k in key)
        rows = rows.sort_by("idx")
        n = rows.num_rows
        digests = np.frombuffer(b"".join(rows.column("digest").to_pylist()), np.uint8).reshape(n, 32)
        levels = full
        if block == 0 and n < fan**full:  # the tree's only block: up to its root and no further
            levels = 0
            while fan**levels < n:
                levels += 1
        nodes, states = _grow(digests, levels, fan)
        packed = lambda parts: b"".join(p.tobytes() for p in parts)
        return pa.table({"tier": pa.array([tier], pa.int32()), "tree": [tree], "block": [block], "n": pa.array([n], pa.int32()), "levels": pa.array([levels], pa.int32()), "nodes": [packed(nodes)], "states": [packed(states)], "digest": [nodes[-1].tobytes()]}, schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([("tier", pa.int32()), ("tree", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("levels", pa.int32()), ("nodes", pa.binary()), ("states", pa.binary()), ("digest", pa.binary())])


def build(nodes: DataFrame, fan: int = 2, most: int = BLOCK) -> list[DataFrame]:
    """The manifest of nodes (tree, idx, digest), tier by tier; the last tier has one block per tree, whose digest is its root."""
    full, out, tier = _levels(fan, most), [], 0
    size, left = fan**full, (nodes.agg(F.max("idx")).first()[0] or 0) + 1
    while True:
        grouped = nodes.select("tree", F.expr(f"idx div {size}").alias("block"), "idx", "digest").groupBy("tree", "block")
        out.append(materialize(grouped.applyInArrow(_build(fan, full, tier), MANIFEST), f"merkle-{tier}"))
        left = -(-left // size)
        if left == 1:
            return out
        nodes, tier = out[-1].select("tree", F.col("block").alias("idx"), "digest"), tier + 1


class _Block:
    """A row of the manifest, unpacked."""

    def __init__(self, n: int, levels: int, nodes: bytes, states: bytes, fan: int) -> None:
        self.n, self.fan, self.sizes = n, fan, _sizes(n, levels, fan)
        flat, kept = np.frombuffer(nodes, np.uint8).reshape(-1, 32), np.frombuffer(states, np.uint8).reshape(-1, fan, 32)
        at = np.cumsum([0, *self.sizes])
        self.nodes = [flat[a:b] for a, b in zip(at, at[1:], strict=False)]
        at = at - n
        self.states = [kept[a:b] for a, b in zip(at[1:], at[2:], strict=False)]

    def steps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Level by level, for each child: its slot, the children of its parent, the state before its slot, the others of its run."""
        child = np.arange(self.n)
        for size, nodes, states in zip(self.sizes, self.nodes, self.states, strict=False):
            parent, slot = child // self.fan, child % self.fan
            run = np.minimum(self.fan, size - parent * self.fan)
            place = np.arange(self.fan - 1)[None, :]
            other = parent[:, None] * self.fan + place + (place >= slot[:, None])
            others = np.where((other < size)[:, :, None], nodes[np.minimum(other, size - 1)], np.uint8(0))
            yield slot, run, states[parent, slot], others
            child = parent


def _step_bytes(slot: np.ndarray, run: np.ndarray, state: np.ndarray, others: np.ndarray) -> np.ndarray:
    """A step of a path as bytes: slot, run, state, others."""
    return np.concatenate([slot.astype(np.uint8)[:, None], run.astype(np.uint8)[:, None], state, others.reshape(len(slot), -1)], axis=1)


def _path_steps(path: bytes, fan: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for row in np.frombuffer(path, np.uint8).reshape(-1, 2 + 32 * fan):
        yield row[:1].astype(int), row[1:2].astype(int), row[None, 2:34], row[34:].reshape(1, fan - 1, 32)


def resume(digests: np.ndarray, slot: np.ndarray, run: np.ndarray, state: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Digests of the parents after replacement: from the retained state, with the replacement and the right siblings only."""
    n = len(digests)
    slot, run = np.broadcast_to(slot, n), np.broadcast_to(run, n)
    now = S.compress(S.pack(np.broadcast_to(state, (n, 32))), S.hex_block(digests))
    others = np.broadcast_to(others, (n, *others.shape[1:]))
    for k in range(others.shape[1]):  # the others stand in page order; those from place `slot` on are to the right
        right = np.flatnonzero((slot <= k) & (k + 1 < run))
        if len(right):
            now[:, right] = S.compress(now[:, right], S.hex_block(others[right, k]))
    out = np.empty((n, 32), np.uint8)
    for r in np.unique(run):
        these = np.flatnonzero(run == r)
        out[these] = S.finish(now[:, these], int(r))
    return out


def _descend(tier: DataFrame, context: DataFrame, fan: int, size: int) -> DataFrame:
    """For each child of a tier's blocks: the path from it to the root of all, its own steps before those of its block."""
    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("path", pa.binary()), ("subroot", pa.binary()), ("root", pa.binary())])

    def run(key: tuple, rows: pa.Table) -> pa.Table:  # noqa: ARG001
        row = rows.to_pylist()[0]
        b = _Block(row["n"], row["levels"], row["nodes"], row["states"], fan)
        own = [_step_bytes(*s) for s in b.steps()]
        paths = [p.tobytes() + row["path"] for p in (np.concatenate(own, axis=1) if own else np.zeros((b.n, 0), np.uint8))]
        first = row["block"] * size
        return pa.table({"tree": [row["tree"]] * b.n, "block": list(range(first, first + b.n)), "path": paths, "subroot": [row["subroot"]] * b.n, "root": [row["root"]] * b.n}, schema=schema)

    return tier.join(context, ["tree", "block"]).groupBy("tree", "block").applyInArrow(run, _CONTEXT)


def _fold(fan: int, names: list[str]) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, leaves: pa.Table, blocks: pa.Table) -> pa.Table:  # noqa: ARG001
        leaves = leaves.sort_by("idx")
        row = blocks.to_pylist()[0]
        b = _Block(row["n"], row["levels"], row["nodes"], row["states"], fan)
        now = np.frombuffer(b"".join(leaves.column("replacement").to_pylist()), np.uint8).reshape(b.n, 32)
        proof: list[np.ndarray] = []
        have: list[np.ndarray] = []
        for steps in (b.steps(), _path_steps(row["path"], fan)):
            for slot, run_, state, others in steps:
                now = resume(now, slot, run_, state, others)
                proof += [np.broadcast_to(others[:, k], (b.n, 32)) for k in range(fan - 1)]
                have += [np.broadcast_to(k + 1 < run_, b.n) for k in range(fan - 1)]
        every = np.stack(proof, axis=1) if proof else np.zeros((b.n, 0, 32), np.uint8)
        there = np.stack(have, axis=1) if have else np.zeros((b.n, 0), bool)
        out = leaves.select(names)
        for name, values in (("subroot", [row["subroot"]] * b.n), ("root", [row["root"]] * b.n), ("proof", [e[t].tobytes() for e, t in zip(every, there, strict=True)]), ("folded_root", [x.tobytes() for x in now])):
            out = out.append_column(name, pa.array(values, pa.binary()))
        return out

    return run


def leaves(docs: DataFrame, replacement: Column | None = None) -> DataFrame:
    """(tree, idx, doc_id, digest, replacement) of every row: its place in the tree of its language, and its leaf."""
    d = docs.select(tree_of(F.col("lang")).alias("tree"), F.col("doc_id"), leaf().alias("digest"), (leaf() if replacement is None else replacement).alias("replacement"))
    return numbered(d, "tree", [F.col("doc_id").asc_nulls_first(), F.col("digest")], "idx")


def fold(rows: DataFrame, fan: int = 2, most: int = BLOCK) -> DataFrame:
    """(doc_id, digest, replacement, subroot, root, proof, folded_root) of leaves(): the whole tree, and what each replacement makes of its root.

    proof holds the digests of the siblings, 32 bytes each, level by level from the leaf to the root of all, left to right.
    """
    tiers, size = build(rows, fan, most), fan ** _levels(fan, most)
    tops = numbered(tiers[-1].select(F.lit("").alias("all"), "tree", "digest"), "all", [F.col("tree")], "idx")
    over = build(tops.select(F.col("all").alias("tree"), "idx", "digest"), fan, most)
    nothing = F.lit(b"").cast("binary")
    context = over[-1].select("tree", "block", nothing.alias("path"), nothing.alias("subroot"), F.col("digest").alias("root"))
    over = [tier.drop("digest") for tier in over]
    for tier in reversed(over):
        context = _descend(tier, context, fan, size)
    subroots = tops.join(context.withColumnRenamed("block", "idx").drop("tree", "subroot"), "idx")
    context = materialize(subroots.select("tree", F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("subroot"), "root"), "merkle-paths")
    for tier in reversed(tiers[1:]):
        context = materialize(_descend(tier.drop("digest"), context, fan, size), "merkle-paths")
    named = ["doc_id", "digest", "replacement"]
    blocks = tiers[0].drop("digest").join(context, ["tree", "block"])
    own = rows.withColumn("block", F.expr(f"idx div {size}"))
    schema = rows.select(*named).withColumns({c: F.lit(b"").cast("binary") for c in ("subroot", "root", "proof", "folded_root")}).schema
    return own.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(_fold(fan, named), schema)


def verify(docs: DataFrame, tampered: Column, fan: int = 2, most: int = BLOCK) -> DataFrame:
    """Each row's leaf, its tree's root, the root of all, the digest of its proof and the root that its tampered leaf folds to.

    tampered: the n_chars that the tampered row has, n_chars itself where it isn't tampered with.
    """
    text = lambda c: F.lower(F.hex(c))
    folded = fold(leaves(docs, leaf(n_chars=tampered)), fan, most)
    return folded.select("doc_id", text("digest").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), F.sha2(text("proof"), 256).alias("proof_sha256"), text("folded_root").alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))
