"""Line deduplication with two Bloom filters.

The 64-bit hashes of all eligible lines (once per document) are dealt out by hash to segments. Each segment keeps two
Bloom filters, of hashes seen once and of hashes seen twice; a hash whose bits are all set in the first goes to the
second. The second filter alone goes back to the documents, and only lines that it suspects are shuffled with their
text, to be counted exactly and to choose the document that keeps them. A false alarm costs a shuffled line and changes
nothing. The filter's size follows the number of lines up to a bound; beyond that it grows fuller and more lines are
suspected, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import arrow_rows, free_name, id_and_text
from auditlake.session import materialise

LEAST_CHARS = 20
LEAST_DOCS = 3
#: Filter bits per line, probes per hash, and the bound of the filter that is broadcast: 2^29 bits, 64 MB.
BITS_PER_LINE = 8
PROBES = 4
MOST_BITS = 1 << 29
SEGMENTS = 64

_WS = " \t\n\x0b\x0c\r"
_FOLD = {c: c + 32 for c in range(65, 91)}


def key_of(line: str) -> str:
    """The line without white space at its ends and with A-Z in lower case."""
    line = line.strip(_WS)
    return line.lower() if line.isascii() else line.translate(_FOLD)


def keys_of(text: str, least: int = LEAST_CHARS) -> list[str]:
    """Key of each line; empty for lines whose key is too short to count."""
    return [k if len(k) >= least else "" for k in map(key_of, text.split("\n"))]


def digests(keys: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(k.encode("utf-8", "replace")) for k in keys), dtype=np.uint64, count=len(keys))


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Positions of each hash in a filter of a power of two bits: one column for each probe. The segment's six bits are not used again."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(26)) | np.uint64(1)
    return np.stack([(low * np.uint64(0x9E3779B1) + np.uint64(k) * high) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(64 - bits.bit_length() + 1) for k in range(PROBES)], axis=1).astype(np.int64)


def segment_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(58)).astype(np.int64)


class Filters:
    """Once-seen and twice-seen filter of a segment, a byte for each bit while they are filled."""

    def __init__(self, bits: int):
        self.bits, self.once, self.twice = bits, np.zeros(bits, dtype=bool), np.zeros(bits, dtype=bool)

    def add(self, hashes: np.ndarray) -> None:
        hashes, many = np.unique(hashes, return_counts=True)
        at = places(hashes, self.bits)
        again = (many > 1) | self.once[at].all(axis=1)
        self.once[at.ravel()] = True
        # hashes of one batch may lie on each other's bits: these are then suspected when they are next seen
        self.twice[at[again].ravel()] = True


def suspects_filter(docs: DataFrame, least: int = LEAST_CHARS, most_bits: int = MOST_BITS):
    """The twice-seen filter of all segments as one packed array, and the bits of a segment."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in arrow_rows(batches, "text"):
            keys = [k for t in texts for k in set(keys_of(t, least)) if k]
            got = digests(keys)
            yield pa.RecordBatch.from_arrays([pa.array(segment_of(got), pa.int64()), pa.array(got.view(np.int64))], ["segment", "hash"])

    found = materialise(docs.select("text").mapInArrow(hashes, "segment long, hash long"), "line-hashes")
    wanted = max(SEGMENTS * 1024, min(most_bits, BITS_PER_LINE * found.count()))
    bits = 1 << ((wanted // SEGMENTS) - 1).bit_length()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, Filters] = {}
        for batch in batches:
            segment, got = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for s in np.unique(segment).tolist():
                own.setdefault(s, Filters(bits)).add(got[segment == s])
        for s, f in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([np.packbits(f.twice, bitorder="little").tobytes()], pa.binary())], ["segment", "filter"])

    whole = np.zeros(SEGMENTS * bits // 8, dtype=np.uint8)
    segments = found.repartition(SEGMENTS, "segment").mapInArrow(fill, "segment long, filter binary")
    for r in segments.toLocalIterator():
        whole[r.segment * bits // 8 : (r.segment + 1) * bits // 8] = np.frombuffer(r.filter, dtype=np.uint8)
    return docs.sparkSession.sparkContext.broadcast(whole), bits


def repeated_lines(docs: DataFrame, least: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, key): lines that the document loses. ``docs`` as ``id_and_text`` gives it."""
    sent, bits = suspects_filter(docs, least, most_bits)

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = sent.value
        for ids, texts in arrow_rows(batches, "doc_id", "text"):
            keys = [(d, k) for d, t in zip(ids, texts) for k in set(keys_of(t, least)) if k]
            if not keys:
                continue
            got = digests([k for _, k in keys])
            at = places(got, bits) + (segment_of(got) * bits)[:, None]
            hit = np.flatnonzero((whole[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([keys[i][0] for i in hit], pa.int64()), pa.array([keys[i][1] for i in hit], pa.string())], ["doc_id", "key"])

    lines = docs.where("doc_id is not null").mapInArrow(suspected, "doc_id long, key string").distinct()
    lines = materialise(lines, "suspects")
    # written, so that a key that many documents hold can be split in the join with it
    kept = materialise(lines.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last")).where(F.col("n_docs") >= least_docs), "repeats")
    return lines.join(kept, "key").where("doc_id < last").select("doc_id", "key")


def _with_lost(docs: DataFrame, name: str, least: int, least_docs: int, most_bits: int) -> DataFrame:
    """``docs`` and one more column, ``name``: the keys of the lines that the row loses."""
    loser = free_name(docs, "loser")
    lost = repeated_lines(id_and_text(docs), least, least_docs, most_bits).groupBy(F.col("doc_id").alias(loser)).agg(F.collect_set("key").alias(name))
    return docs.join(lost, F.col("doc_id").cast("long") == F.col(loser), "left").drop(loser)


def _cut(text: str, gone: list[str] | None) -> tuple[int, int, str]:
    """(lines before, lines dropped, text left)"""
    own = text.split("\n")
    if not gone:
        return len(own), 0, text
    gone = set(gone)
    left = [line for line in own if key_of(line) not in gone]
    return len(own), len(own) - len(left), "\n".join(left)


def drop_repeats(docs: DataFrame, least: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_lines`` (before), ``n_dropped``, ``kept`` (the text left).

    A null or empty text is one empty line. Repeated rows of one ``doc_id`` are one document and lose the same lines. A
    row without ``doc_id`` is nobody's document: it neither counts nor loses lines. An empty table gives no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, lost in arrow_rows(batches, "doc_id", "text", "lost"):
            for lo in range(0, len(ids), 500):
                rows = zip(*(_cut(t, gone) for t, gone in zip(texts[lo : lo + 500], lost[lo : lo + 500])))
                kinds = (pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + 500], pa.int64()), *(pa.array(x, k) for x, k in zip(rows, kinds))], ["doc_id", "n_lines", "n_dropped", "kept"])

    return _with_lost(id_and_text(docs), "lost", least, least_docs, most_bits).mapInArrow(cut, "doc_id long, n_lines long, n_dropped long, kept string")


def rewrite(docs: DataFrame, least: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, most_bits: int = MOST_BITS) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; ``n_chars``, where there is one, follows. A null text stays null; other columns stay, whatever their names."""
    name = free_name(docs, "lost")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                names = part.schema.names
                texts, lost = part.column(names.index("text")).to_pylist(), part.column(names.index(name)).to_pylist()
                kept = [t if t is None else _cut(t, gone)[2] for t, gone in zip(texts, lost)]
                columns = dict(zip(names, part.columns))
                columns["text"] = pa.array(kept, pa.string())
                if "n_chars" in columns:
                    sizes = [n if t is k or t is None else len(k) for n, t, k in zip(columns["n_chars"].to_pylist(), texts, kept)]
                    columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
                del columns[name]
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return _with_lost(docs, name, least, least_docs, most_bits).mapInArrow(cut, docs.schema)
