"""SimHash near-duplicates found at the anchor points of a covering code.

The 64 bits are cut into three parts of 25, 25 and 14 bits. Two fingerprints with four differing bits or fewer differ
in at most one bit of the first part, or at most one of the second, or in none of the third (1 + 1 + 0 + 3 > 4). The
anchors of the two long parts are the words of the binary Golay code of length 23, which is perfect: each word lies
within radius 3 of exactly one anchor; two further bits must agree with the anchor's as they stand (each pattern of
them has its own set of anchors). A fingerprint is at home at its nearest anchor and visits every anchor within the
covering radius plus the part's threshold, 3 + 1; the two of a pair therefore meet at the home of either. The anchors
of the short part are all its points (radius 0, threshold 0). Fingerprints are compared only at anchors, home against
visitors, and of each anchor only a spanning set of links is handed on.

Equal fingerprints are one fingerprint throughout, so a group of copies of any size is one row. An anchor that is home
to very many different fingerprints is dealt out to several tasks, each with a part of the homes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import arrow_rows, id_and_text, packed, unpacked
from auditlake.llm.components import components
from auditlake.session import materialise

SHINGLE = 4
THRESHOLD = 4
#: (lowest bit, bits, threshold) of the parts; their thresholds plus one add up to THRESHOLD + 1.
PARTS = ((0, 25, 1), (25, 25, 1), (50, 14, 0))
CODE_BITS = 23
RADIUS = 3
#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Homes of one anchor that one task compares.
HOMES = 20_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str) -> int:
    """Bit i is 1 if it is set in over half of the 64-bit hashes of the 4-word shingles, repeats included; 0 without words."""
    import xxhash

    words = text.encode("utf-8", "replace").translate(_FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, 42)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    digest = xxhash.xxh64_intdigest
    total, count = np.zeros(64, dtype=np.int64), len(words) - SHINGLE + 1
    starts, ends = (end - size)[:count].tolist(), end[SHINGLE - 1 :].tolist()
    for lo in range(0, count, 4096):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[lo : lo + 4096], ends[lo : lo + 4096])], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``bits`` (the fingerprint as a signed long), ``said`` (SHA-256 of the text) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, said in arrow_rows(batches, "doc_id", "text", "said"):
            bits = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bits), pa.array(said, pa.string())], ["doc_id", "bits", "said"])

    return id_and_text(docs).withColumn("said", F.sha2("text", 256)).mapInArrow(run, "doc_id long, bits long, said string")


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of each word's code bits on division by the generator: 0 for the words of the code."""
    rest = words & ((1 << CODE_BITS) - 1)
    for bit in range(CODE_BITS - 1, CODE_BITS - 13, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def patterns(bits: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """All error words of ``bits`` bits and weight up to ``reach``, by syndrome: words in that order, and where each syndrome's begin.

    The word that leads from a word to its nearest anchor is the first of its syndrome.
    """
    from itertools import combinations

    found = np.array([sum(1 << b for b in c) for w in range(reach + 1) for c in combinations(range(bits), w)], dtype=np.int64)
    syndrome = syndromes(found)
    away = np.bitwise_count(found >> CODE_BITS) * 64 + np.bitwise_count(found)  # the pattern of further bits kept comes first
    order = np.lexsort((away, syndrome))
    return found[order], np.searchsorted(syndrome[order], np.arange(2049))


def visits(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For fingerprints: number of the fingerprint, anchor (a long), whether it is at home there."""
    out = []
    for k, (low, width, threshold) in enumerate(PARTS):
        part = (bits >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64)
        if threshold:
            words, begin = _table(width, RADIUS + threshold)
            s = syndromes(part)
            many = begin[s + 1] - begin[s]
            who = np.repeat(np.arange(len(part)), many)
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            anchor, home = part[who] ^ words[np.repeat(begin[s], many) + nth], nth == 0
        else:
            who, anchor, home = np.arange(len(part)), part, np.ones(len(part), dtype=bool)
        out.append((who, anchor | k << 32, home))
    return tuple(np.concatenate(x) for x in zip(*out))


_TABLES: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _table(bits: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    if (bits, reach) not in _TABLES:
        _TABLES[bits, reach] = patterns(bits, reach)
    return _TABLES[bits, reach]


class Forest:
    """Union of the members of one anchor; tells which links join two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor and part, homes first: spanning links (low, high) of fingerprints within the threshold."""
    key, homes, forest = None, [], Forest()
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, salt, away, node, bits = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("anchor", "salt", "away", "node", "bits"))
        bits = bits.astype(np.int64).view(np.uint64)
        edge = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])))
        low, high = [], []
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(anchor)]):
            if key != (anchor[a], salt[a]):
                key, homes, forest = (anchor[a], salt[a]), [], Forest()
            here = int(np.count_nonzero(~away[a:b]))
            if here:
                homes.append((node[a : a + here], bits[a : a + here]))
                if len(homes) > 1:
                    homes = [tuple(np.concatenate(x) for x in zip(*homes))]
            if not homes:
                continue
            own, own_bits = homes[0]
            step = max(1, 2_000_000 // len(own))
            for lo in range(a, b, step):
                at = slice(lo, min(b, lo + step))
                i, j = np.nonzero(np.bitwise_count(own_bits[:, None] ^ bits[None, at]) <= THRESHOLD)
                x, y = own[i], node[at][j]
                for p, q in zip(x[x != y].tolist(), y[x != y].tolist()):
                    if forest.join(p, q):
                        low.append(min(p, q))
                        high.append(max(p, q))
        if low:
            yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["low", "high"])


def links(prints: DataFrame, homes: int = HOMES) -> DataFrame:
    """Spanning links (low, high) between the nodes of distinct fingerprints (``node``, ``bits``) with THRESHOLD differing bits or fewer."""

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, anchor, home = visits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(anchor[home])], ["anchor"])

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 5000):
                batch = whole.slice(lo, 5000)
                bits, node = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("bits", "node"))
                who, anchor, home = visits(bits.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(~home), pa.array(node[who]), pa.array(bits[who])], ["anchor", "away", "node", "bits"])

    # at most 3 rows for each ``homes`` fingerprints, of 12 bytes: 3 MB for 2 * 10^9 of them
    crowded = prints.select("bits").mapInArrow(at_home, "anchor long").groupBy("anchor").count().where(F.col("count") > homes).select("anchor", F.ceil(F.col("count") / homes).cast("int").alias("n_parts"))
    rows = prints.select("node", "bits").mapInArrow(replicate, "anchor long, away boolean, node long, bits long").join(F.broadcast(crowded), "anchor", "left")
    own = F.pmod(F.xxhash64("bits"), F.coalesce(F.col("n_parts"), F.lit(1))).cast("int")
    every = F.sequence(F.lit(0), F.coalesce(F.col("n_parts"), F.lit(1)) - 1)
    alone = F.array(F.lit(0))
    # a home is compared in its own part; in the other parts it is a visitor like the rest
    parts = F.when(F.col("n_parts").isNull(), alone).otherwise(every)
    dealt = rows.withColumn("own", own).withColumn("salt", F.explode(parts)).select("anchor", "salt", (F.col("away") | (F.col("salt") != F.col("own"))).alias("away"), "node", "bits")
    return dealt.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "away").mapInArrow(_compare, "low long, high long")


def _classes(rows: DataFrame, homes: int) -> DataFrame:
    """``rows`` (as ``fingerprints`` gives them, written) with ``component_id``."""
    prints = materialise(rows.groupBy("bits").agg(F.min("doc_id").alias("node")), "prints")
    roots = components(links(prints.where("node is not null"), homes))
    named = prints.join(roots, "node", "left").select(F.col("bits").alias("print"), F.coalesce("root", "node").alias("component_id"))
    return rows.join(named, F.col("bits") == F.col("print")).drop("print")


def classes(docs: DataFrame, homes: int = HOMES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``bits`` and ``component_id``, the smallest ``doc_id`` that can be reached over links.

    Documents without words (null, empty, white space) have fingerprint 0 and are linked like any other. Repeated rows
    stay, each with its class. A row without ``doc_id`` gets its class but is nobody's smallest id and links no others;
    where no row of a class has an id, the class is null. Columns other than ``doc_id`` and ``text`` play no part. An
    empty table gives none.
    """
    return _classes(materialise(fingerprints(docs).select("doc_id", "bits"), "fingerprints"), homes)


def representatives(docs: DataFrame, homes: int = HOMES) -> DataFrame:
    """``docs`` with one row of each class: of those with its smallest ``doc_id`` that of the smallest fingerprint, then of the smallest digest of the text.

    A ``doc_id`` on rows of different texts thus keeps one row in each of their classes; of rows equal in ``doc_id`` and
    text one stays. Rows without ``doc_id`` stay. Columns as before, whatever their names.
    """
    rows = materialise(fingerprints(docs), "fingerprints")
    best = _classes(rows, homes).where("doc_id is not null").groupBy("component_id").agg(F.min(F.struct("doc_id", "bits", "said")).alias("best"))
    kept = best.select(F.col("best.doc_id").alias("kept_id"), F.col("best.said").alias("kept_text"))
    given = packed(docs).withColumn("said", F.sha2("text", 256))
    one = given.where("doc_id is not null").join(kept, (F.col("doc_id") == F.col("kept_id")) & (F.col("said") == F.col("kept_text")), "left_semi").dropDuplicates(["doc_id", "said"])
    return unpacked(one.unionByName(given.where("doc_id is null")), docs.columns)
