"""Merkle manifest of a dataset, kept as an append log in postorder.

The rows of a group (a tree) are leaves in order; every two consecutive nodes of a level become one node of the next
(the last may be alone), until one is left. A log of a tree holds its nodes in the order in which they are complete: a
node stands right behind its subtree. A perfect subtree of 2^h leaves has 2^(h+1) - 1 nodes, so the trees left of leaf m
hold 2m - popcount(m) nodes, and the place of every node follows from its height, its index and the number of leaves
alone (``position``): no pointer is stored, and builders need not wait for each other.

Builders work on aligned blocks of 2^BLOCK_BITS nodes, so a block's part of the log is one run of it; the blocks' roots
are the leaves of the next tier of builders. The roots of the groups are the leaves of one more tree, the root of which
stands for the whole dataset. Proofs are read from the top tier down: a block gets its own siblings once from the tier
above, then addresses those of its nodes in its part of the log. A group of any size is thus only ever held in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.session import materialise

BLOCK_BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_AT = 33  # bits of a row's number within its partition in monotonically_increasing_id


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode("utf-8")).hexdigest()


def leaf_digest(fields: Iterable[Column]) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its number of UTF-8 bytes, ``:`` and its value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return (n - 1).bit_length() if n > 1 else 0


def position(level, index, n: int) -> np.ndarray:
    """Place in a tree's log of the node of a level (0: leaves) and index, in closed form; ``n`` leaves."""
    level, index = np.asarray(level, dtype=np.int64), np.asarray(index, dtype=np.int64)
    ones = lambda x: np.bitwise_count(x).astype(np.int64)
    zeros = lambda x: ones((x & -x) - 1)
    m = (index + 1) << level
    perfect = 2 * m - ones(m) - 1 - (zeros(m) - level)
    # nodes that lack leaves are complete only at the end, lowest first; the lowest lies above the last perfect one
    last = np.int64(n)
    return np.where(m <= last, perfect, 2 * last - ones(last) + level - zeros(last) - 1)


def append(digests: list[str], first: int, low: int, high: int, n: int) -> Iterator[tuple[int, int, str]]:
    """Nodes (level, index, digest) of the levels ``low`` to ``high`` over consecutive nodes of level ``low``, in completion order.

    ``first`` is the index of the first one, a multiple of 2^(high - low); ``n`` the number of leaves of the tree.
    """
    left: dict[int, str] = {}
    end = ((n - 1) >> low) if n else -1
    for index, node in enumerate(digests, first):
        level, last = low, index == end
        yield level, index, node
        while level < high and (index & 1 or last):
            node = digest(left[level], node) if index & 1 else digest(node)
            index, level = index >> 1, level + 1
            yield level, index, node
        left[level] = node


def ranked(rows: DataFrame, within: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` (written out) with ``rank``, from 0 within the columns ``within`` (nulls are a value, first) by ``order``, and ``n``, their number.

    Rows are sorted in ranges, so a group of any size is spread; what is added up is one row per range and group.
    """
    at = F.shiftright("_at", _AT)
    keys = [*within, *order]
    placed = rows.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys])
    placed = materialise(placed.withColumn("_at", F.monotonically_increasing_id()), name)
    counts = placed.groupBy(*within, at.alias("_part")).agg(F.count("*").alias("_many"), F.min("_at").alias("_first"))
    group = Window.partitionBy(*within) if within else Window.partitionBy()
    before = F.sum("_many").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_many")
    pieces = counts.select(*[F.col(w).alias(f"_{w}") for w in within], "_part", "_first", before.alias("_before"), F.sum("_many").over(group).alias("n"))
    same = at == F.col("_part")
    for w in within:
        same = same & F.col(w).eqNullSafe(F.col(f"_{w}"))
    return placed.join(pieces, same).select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("rank"), "n")


@dataclass
class Log:
    """Trees in tiers of segments: ``tiers[t]`` has a row for each node of a block (tree, n, block, level, index, pos, digest and the leaves' carried columns)."""

    tiers: list[DataFrame]
    carried: list[str]
    bits: int

    def nodes(self) -> DataFrame:
        """The log itself: tree, pos, level, index, digest; each node once."""
        shown = ["tree", "pos", "level", "index", "digest"]
        out = self.tiers[0].select(*shown)
        for t, tier in enumerate(self.tiers[1:], 1):
            out = out.unionByName(tier.where(F.col("level") > t * self.bits).select(*shown))
        return out

    def roots(self) -> DataFrame:
        """tree, n, root"""
        last = len(self.tiers) - 1
        return self.tiers[last].where(_is_root(last * self.bits)).select("tree", "n", F.col("digest").alias("root"))


def _is_root(low: int) -> Column:
    """Whether a node of a tier that starts at level ``low`` is all that is left of its tree. A tree complete below ``low`` has its root there."""
    leaves = lambda level: F.call_function("shiftleft", F.lit(1).cast("long"), level)
    level = F.col("level")
    return (F.col("index") == 0) & (leaves(level) >= F.col("n")) & ((level == low) | (leaves(level - 1) < F.col("n")))


def _builder(low: int, bits: int, kept: list[str]):
    """Function that makes the segment of one block of nodes of level ``low``."""

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("index")
        n, first = int(rows["n"].iloc[0]), int(rows["index"].iloc[0])
        made = append(rows["digest"].tolist(), first, low, min(low + bits, max(height(n), low)), n)
        level, index, node = (list(x) for x in zip(*made))
        out = pd.DataFrame({"tree": int(rows["tree"].iloc[0]), "n": n, "block": first >> bits, "level": level, "index": index, "pos": position(level, index, n), "digest": node})
        for c in kept:
            own = dict(zip(rows["index"], rows[c]))
            out[c] = pd.Series([own[i] if at == low else None for at, i in zip(level, index)], dtype=object)
        return out

    return block


def _reader(low: int, bits: int, kept: list[str], extra: list[str]):
    """Function that reads the siblings of all nodes of level ``low`` of one block from its segment, and adds those of the block."""

    def read(rows: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        pos, node, n = rows["pos"].to_numpy(), rows["digest"].to_numpy(), int(rows["n"].iloc[0])
        start = rows[rows["level"] == low].sort_values("index")
        index = start["index"].to_numpy()
        path: list[list[str]] = [[] for _ in index]
        for level in range(low, min(low + bits, max(height(n), low))):
            beside = (index >> (level - low)) ^ 1
            there = np.flatnonzero(beside << level < n)
            at = np.searchsorted(pos, position(level, beside[there], n))
            for i, d in zip(there.tolist(), node[at].tolist()):
                path[i].append(d)
        out = start[["tree", "n", "index", "digest", *kept]].copy()
        rest = list(upper["siblings"].iloc[0])
        out["siblings"] = [p + rest for p in path]
        for c in extra:
            out[c] = upper[c].iloc[0]
        return out

    return read


def build(leaves: DataFrame, most: int, carried: list[str], name: str, bits: int = BLOCK_BITS) -> Log:
    """The log of the trees whose ``leaves`` (tree, n, rank, digest and the ``carried`` columns, strings) are given, ``most`` in one tree; each tier is written."""
    fields = ["tree", "n", "block", "level", "index", "pos", "digest"]
    kinds = "tree long, n long, block long, level int, index long, pos long, digest string"
    tiers: list[DataFrame] = []
    source = leaves.select("tree", "n", F.col("rank").alias("index"), "digest", *carried)
    for t in range(max(1, -(-height(most) // bits))):
        kept = carried if t == 0 else []

        schema = ", ".join([kinds, *[f"`{c}` string" for c in kept]])
        grouped = source.withColumn("block", F.shiftright("index", bits)).groupBy("tree", "block")
        tiers.append(materialise(grouped.applyInPandas(_builder(t * bits, bits, kept), schema).select(*fields, *kept), f"{name}-{t}"))
        top = (t + 1) * bits
        # of a tree that is complete below this level its root goes on as it is
        source = tiers[t].where((F.col("level") == top) | _is_root(t * bits)).select("tree", "n", "index", "digest")
    return Log(tiers, carried, bits)


def proofs(log: Log, above: DataFrame) -> DataFrame:
    """For each leaf: tree, n, rank, digest, carried columns, ``siblings`` (its own first, then those handed on) and the tree's columns of ``above``.

    ``above`` has a row for each tree: tree, siblings (of the tree's root), and more columns that are handed on.
    """
    extra = [c for c in above.columns if c not in ("tree", "siblings")]
    types = {f.name: f.dataType.simpleString() for f in above.schema}
    handed = above.withColumn("block", F.lit(0).cast("long"))
    bits = log.bits
    for t in range(len(log.tiers) - 1, -1, -1):
        kept = log.carried if t == 0 else []
        tier = log.tiers[t]
        schema = ", ".join(["tree long, n long, index long, digest string", *[f"`{c}` string" for c in kept], "siblings array<string>", *[f"`{c}` {types[c]}" for c in extra]])
        found = tier.groupBy("tree", "block").cogroup(handed.groupBy("tree", "block")).applyInPandas(_reader(t * bits, bits, kept, extra), schema)
        handed = found.select("tree", F.col("index").alias("block"), "siblings", *extra)
    return found.withColumnRenamed("index", "rank")


def fold(leaf: str, rank: int, n: int, siblings: list[str]) -> tuple[str, int]:
    """Root recomputed from a leaf and its siblings, and how many of these were used."""
    used = 0
    for _ in range(height(n)):
        if rank & 1:
            leaf, used = digest(siblings[used], leaf), used + 1
        elif rank + 1 < n:
            leaf, used = digest(leaf, siblings[used]), used + 1
        else:
            leaf = digest(leaf)
        rank, n = rank >> 1, (n + 1) >> 1
    return leaf, used


def verify(found: DataFrame, leaf: str) -> DataFrame:
    """``found`` (as ``manifest`` gives it) with ``folded_root``, from the column ``leaf`` by both trees, and ``verified``."""
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema], "folded_root string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (leaf, "rank", "n", "tree", "n_trees", "siblings")}
            folded = []
            for d, rank, n, tree, trees, siblings in zip(*value.values()):
                sub, used = fold(d, rank, n, siblings)
                folded.append(fold(sub, tree, trees, siblings[used:])[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(folded, pa.string())], [*batch.schema.names, "folded_root"])

    return found.mapInArrow(run, schema).withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest(docs: DataFrame, claim: Column | None = None, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, bits: int = BLOCK_BITS) -> DataFrame:
    """One row per row of ``docs``: ``order``, ``tree``, ``rank``, ``n``, ``n_trees``, ``leaf``, ``claim``, ``siblings``, ``subroot`` and ``root``.

    ``claim``, a column over ``docs``, is a digest to be held against the manifest (null by default). Rows of a group
    are ordered by ``order``, then by leaf, so that repeated rows, which have equal leaves, give the same root in
    whatever order they come. Nulls in any field are ``-``; a null group is a group, the first; a null ``order`` comes
    first; a null or empty text is a leaf like any other. Columns not in ``fields`` play no part and may have any name.
    An empty table has no rows.
    """
    claim = F.lit(None).cast("string") if claim is None else claim
    read = docs.select(F.col(order).alias("_order"), F.col(group).alias("_group"), leaf_digest([F.col(f) for f in fields]).alias("digest"), claim.alias("claim"))
    kind = read.schema["_order"].dataType
    leaves = ranked(read, ["_group"], ["_order", "digest"], "leaves")
    groups = ranked(leaves.groupBy("_group").agg(F.max("n").alias("many")), [], ["_group"], "groups")
    trees = materialise(groups.select(F.col("_group").alias("_name"), F.col("rank").alias("tree"), F.col("n").alias("n_trees"), "many"), "trees")
    most, n_trees = trees.agg(F.max("many"), F.max("n_trees")).first()
    numbered = leaves.join(trees, F.col("_group").eqNullSafe(F.col("_name"))).select("tree", "n", "rank", "digest", F.col("_order").cast("string").alias("order"), "claim")
    log = build(numbered, most or 0, ["order", "claim"], "log", bits)
    zero = F.lit(0).cast("long")
    subroots = log.roots().join(trees, "tree").select(zero.alias("tree"), F.col("n_trees").alias("n"), F.col("tree").alias("rank"), F.col("root").alias("digest"))
    top = build(subroots, n_trees or 0, [], "top", bits)
    whole = top.roots().select("tree", F.array().cast("array<string>").alias("siblings"), "root")
    above = proofs(top, whole).select(F.col("rank").alias("tree"), F.col("n").alias("n_trees"), F.col("digest").alias("subroot"), "root", "siblings")
    found = proofs(log, above)
    return found.select(F.col("order").cast(kind).alias(order), "tree", "rank", "n", "n_trees", F.col("digest").alias("leaf"), "claim", "siblings", "subroot", "root")
