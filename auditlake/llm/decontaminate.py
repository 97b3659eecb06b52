"""Benchmark decontamination with one FM-index per shard of the training documents.

A task gathers its documents into shards of a bounded number of words, indexes each shard (suffix order over word
ids, the preceding words in a wavelet matrix, sampled suffix positions) and searches every benchmark window in it by
backward search. Found rows are walked back to a sampled position, which gives the word at which the window starts;
the windows' spans are merged into removal spans. Documents are neither shuffled nor gathered; the benchmark's
distinct windows travel in blocks of bounded size, as many as it takes, so a benchmark of any size can be searched.
A text that occurs often in a shard is indexed once. A document longer than a shard is cut into overlapping pieces as
it is read; its spans and items are carried from shard to shard, so no shard grows with a document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import arrow_rows, id_and_text
from auditlake.session import materialise

WINDOW = 10
#: Words per shard; ranks and positions of a shard are packed into one 64-bit number to be sorted.
SHARD_WORDS = 1 << 19
#: Most words of a piece, and of a shard before its last piece: both together fit ``MOST_SYMBOLS``.
MOST_WORDS = 1 << 20
#: Two ranks and a position of so many symbols fill 63 bits.
MOST_SYMBOLS = 1 << 21
#: Characters of a text that are cut into words at once.
SLICE = 1 << 20
#: Every so many words a suffix position is kept.
SAMPLE = 16
#: Windows per block that is sent to the executors.
BLOCK_WINDOWS = 100_000

# Word characters are ASCII letters and digits and everything beyond ASCII; in UTF-8 that is a table of bytes.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def pieces_of(text: str, most: int, width: int) -> Iterator[tuple[int, list[bytes]]]:
    """A text's words in pieces of ``most`` words at most, each with the number of its first word.

    A piece starts a window's length before the end of the one before it, less one word. A text without words has none.
    """
    words, tail, first = [], [], 0
    for at in range(0, len(text), SLICE):
        part = text[at : at + SLICE].encode("utf-8", "replace").translate(_FOLD)
        # a word that goes on in the next slice waits for its end
        cut = part.rfind(b" ") if at + SLICE < len(text) else len(part)
        if cut < 0:
            tail.append(part)
            continue
        words += b"".join([*tail, part[:cut]]).split()
        tail = [part[cut:]]
        while len(words) > most:
            yield first, words[:most]
            words, first = words[most - width + 1 :], first + most - width + 1
    if words:
        yield first, words


class Wavelet:
    """Ranks of symbols in a sequence: one bit vector with counts per 64 positions for each bit of a symbol, highest first."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.n, self.bits, self.levels = len(seq), bits, []
        room = (self.n // 64 + 1) * 64
        for level in reversed(range(bits)):
            ones = (seq >> level & 1).astype(bool)
            padded = np.zeros(room, dtype=bool)
            padded[: self.n] = ones
            blocks = np.packbits(padded, bitorder="little").view("<u8")
            counts = np.zeros(len(blocks) + 1, dtype=np.int32)
            np.cumsum(np.bitwise_count(blocks), out=counts[1:])
            self.levels.append((blocks, counts, self.n - int(counts[-1])))
            seq = np.concatenate([seq[~ones], seq[ones]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        blocks, counts, _ = self.levels[level]
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return counts[block] + np.bitwise_count(blocks[block] & below)

    def ranks(self, symbols: np.ndarray, *ats: np.ndarray) -> list[np.ndarray]:
        """How often each symbol stands before each position."""
        k, n = len(ats), len(symbols)
        at = np.concatenate([np.zeros(n, dtype=np.int64), *ats]).astype(np.int64)
        symbols = np.tile(symbols, k + 1)
        for i in range(self.bits):
            one = (symbols >> (self.bits - 1 - i)) & 1
            ones = self._ones(i, at)
            at = np.where(one == 1, self.levels[i][2] + ones, at - ones)
        return [at[n * (j + 1) : n * (j + 2)] - at[:n] for j in range(k)]


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in order; symbol 0 ends a document, and of two such ends the earlier is the smaller."""
    n = len(seq)
    if n > MOST_SYMBOLS:
        raise ValueError(f"{n} symbols are more than the {MOST_SYMBOLS} whose ranks and positions fit 64 bits")
    bits = max(1, (n - 1).bit_length())
    low = np.int64((1 << bits) - 1)
    key = (seq.astype(np.int64) << bits) | np.arange(n)
    key.sort()
    at, first = key & low, key >> bits
    new = np.ones(n, dtype=bool)
    new[1:] = (first[1:] != first[:-1]) | (first[1:] == 0)
    start = np.flatnonzero(new)
    rank = np.empty(n, dtype=np.int64)
    rank[at] = np.repeat(start, np.diff(np.append(start, n)))
    single = new & np.append(new[1:], True)
    left, depth = at[~single], 1
    while len(left):
        # the group of a suffix, the rank of what follows after ``depth`` words, its position
        key = ((rank[left] << bits | rank[left + depth]) << bits) | left
        key.sort()
        left, pair = key & low, key >> bits
        group = pair >> bits
        index = np.arange(len(left))
        new_group = np.ones(len(left), dtype=bool)
        new_group[1:] = group[1:] != group[:-1]
        new = np.ones(len(left), dtype=bool)
        new[1:] = pair[1:] != pair[:-1]
        rank[left] = group + np.maximum.accumulate(np.where(new, index, 0)) - np.maximum.accumulate(np.where(new_group, index, 0))
        single = new & np.append(new[1:], True)
        left, depth = left[~single], depth * 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    return order


class Index:
    """FM-index of a sequence of word ids in which 0 ends each document."""

    def __init__(self, seq: np.ndarray):
        order = suffix_order(seq)
        self.before = seq[order - 1]
        self.wavelet = Wavelet(self.before, max(1, int(seq.max()).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq))])
        after_end = np.ones(len(seq), dtype=bool)
        after_end[1:] = seq[:-1] == 0
        kept = (order % SAMPLE == 0) | after_end[order]
        self.kept, self.position = np.cumsum(kept) * kept, order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of the phrases that occur, and their numbers. ``phrases``: ids, right-aligned."""
        live = np.arange(len(phrases))
        lo = np.zeros(len(phrases), dtype=np.int64)
        hi = np.full(len(phrases), len(self.before), dtype=np.int64)
        width = phrases.shape[1]
        for back in range(width):
            step = lengths[live] > back
            if not step.any():
                break
            going = live[step]
            symbol = phrases[going, width - 1 - back].astype(np.int64)
            a, b = self.wavelet.ranks(symbol, lo[going], hi[going])
            lo[going], hi[going] = self.first[symbol] + a, self.first[symbol] + b
            live = live[hi[live] > lo[live]]
        return live, lo[live], hi[live]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position at which the suffix of each row starts."""
        at, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        open_ = np.flatnonzero(self.kept[at] == 0)
        while len(open_):
            symbol = self.before[at[open_]].astype(np.int64)
            at[open_] = self.first[symbol] + self.wavelet.ranks(symbol, at[open_])[0]
            steps[open_] += 1
            open_ = open_[self.kept[at[open_]] == 0]
        return self.position[self.kept[at] - 1] + steps


class Block:
    """A block of distinct benchmark windows: their words as numbers in the block's vocabulary."""

    def __init__(self, rows: list[tuple[list[bytes], list[int]]], width: int):
        number: dict[bytes, int] = {}
        self.phrases = np.zeros((len(rows), width), dtype=np.int32)
        self.lengths = np.array([len(w) for w, _ in rows], dtype=np.int64)
        self.items = [items for _, items in rows]
        for i, (words, _) in enumerate(rows):
            self.phrases[i, width - len(words) :] = [number.setdefault(w, len(number)) for w in words]
        self.vocabulary = list(number)
        self.pad = np.arange(width)[None, :] < width - self.lengths[:, None]


def windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct windows with the ids of their items: ``words`` (array of binary), ``items`` (array of long).

    An item without words has none, a null text has no words, an item without an id gives windows without items.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in arrow_rows(batches, "item_id", "text"):
            for item, text in zip(ids, texts):
                w = words_of(text)
                found = list({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}) if w else []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array([list(x) for x in found], pa.list_(pa.binary()))], ["item_id", "words"])

    plain = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(cut, "item_id long, words array<binary>").groupBy("words").agg(F.collect_set("item_id").alias("items"))


def blocks(benchmark: DataFrame, width: int = WINDOW, most: int = BLOCK_WINDOWS) -> list:
    """The benchmark's windows as broadcast blocks of about ``most`` windows at most; the driver holds one block at a time."""
    context = benchmark.sparkSession.sparkContext
    found = materialise(windows(benchmark, width), "windows")
    count = -(-found.count() // most)
    sent = []
    for k in range(count):
        part = found if count == 1 else found.where(F.pmod(F.xxhash64("words"), F.lit(count)) == k)
        rows = [([bytes(w) for w in r.words], sorted(r.items)) for r in part.toLocalIterator()]
        if rows:
            sent.append(context.broadcast(Block(rows, width)))
    return sent


class Shard:
    """Distinct texts of a task, as word ids, up to a bounded number of words."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.ids: list[np.ndarray] = []
        self.starts: list[int] = []
        self.words = 0

    def add(self, words: list[bytes]) -> int:
        number = self.number
        got = np.fromiter((number.setdefault(w, len(number) + 1) for w in words), dtype=np.int32, count=len(words))
        self.ids += [got, np.zeros(1, dtype=np.int32)]
        self.starts.append(self.words)
        self.words += len(words) + 1
        return len(self.starts) - 1

    def search(self, sent: list) -> list[tuple[np.ndarray, np.ndarray, list[int]]]:
        """For each added text: starts and ends of the windows found in it (in words), and the items they belong to."""
        seq = np.concatenate(self.ids)
        index, start = Index(seq), np.array(self.starts, dtype=np.int64)
        at, length, item = [], [], [set() for _ in self.starts]
        for block in (b.value for b in sent):
            here = np.array([self.number.get(w, 0) for w in block.vocabulary], dtype=np.int32)
            phrases = here[block.phrases]
            possible = np.flatnonzero(((phrases > 0) | block.pad).all(axis=1))
            found, lo, hi = index.search(phrases[possible], block.lengths[possible])
            if not len(found):
                continue
            many = hi - lo
            rows = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            which = np.repeat(possible[found], many)
            spots = index.locate(rows)
            at.append(spots)
            length.append(block.lengths[which])
            text = np.searchsorted(start, spots, side="right") - 1
            for t, w in np.unique(np.stack([text, which]), axis=1).T.tolist():
                item[t].update(block.items[w])
        if not at:
            return [(np.empty(0, np.int64), np.empty(0, np.int64), [])] * len(self.starts)
        at, length = np.concatenate(at), np.concatenate(length)
        order = np.argsort(at, kind="stable")
        at, length = at[order], length[order]
        edge = np.searchsorted(at, np.append(start, self.words))
        return [(at[a:b] - s, at[a:b] - s + length[a:b], sorted(i)) for a, b, s, i in zip(edge[:-1], edge[1:], self.starts, item)]


def merge(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one. ``starts`` are in order."""
    if not len(starts):
        return []
    reach = np.maximum.accumulate(ends)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = starts[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return list(zip(starts[new].tolist(), reach[last].tolist()))


class Judged:
    """What is known of a text so far: its words, merged removal spans in order, items."""

    def __init__(self):
        self.words, self.spans, self.items, self.longest = 0, [], set(), 0

    def take(self, starts: np.ndarray, ends: np.ndarray, items: list[int]) -> None:
        """Adds what a piece gives; pieces come in order and overlap, so spans at the border may belong together."""
        if len(starts):
            self.longest = max(self.longest, int((ends - starts).max()))
        got, back = merge(starts, ends), []
        while got and self.spans and self.spans[-1][1] >= got[0][0]:
            back.append(self.spans.pop())
        if back:
            starts, ends = np.array(sorted(back + got)).T
            got = merge(starts, ends)
        self.spans += got
        self.items.update(items)


SCHEMA = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<long>"


def occurrences(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per row of ``docs``: ``n_words``, removal ``spans`` in words (end exclusive, merged), ``items`` that occur.

    A null or empty text has no words and no spans; a null ``doc_id`` stays; repeated rows stay and are each judged; an
    empty benchmark finds nothing; an empty table gives no rows.
    """
    return _found(docs, benchmark, width, shard_words, "spans")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` without the documents in which a window occurs; columns as before. Nulls as in ``occurrences``."""
    return _found(docs, benchmark, width, shard_words, "clean")


def cut(docs: DataFrame, benchmark: DataFrame, drop: bool = True, width: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with the removal spans cut out of their texts, from a span's first word to the end of its last; ``n_chars``, where there is one, follows.

    With ``drop``, documents that hold a window of full width go instead, so that only items shorter than that are cut
    out: the words of such an item are no sign of a leak by themselves. Texts without a span, null and empty ones stay
    as they are; columns as before, whatever their names. An empty benchmark changes nothing.
    """
    return _found(docs, benchmark, width, shard_words, "drop" if drop else "cut")


#: A word, once A-Z are in lower case.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less the words of the spans (in words, merged, in order) and what stands between them."""
    left, at, waiting = [], 0, list(reversed(spans))
    begin = None
    for number, word in enumerate(_WORD.finditer(text.translate(_LOWER))):
        if not waiting:
            break
        start, end = waiting[-1]
        if number == start:
            begin = word.start()
        if number == end - 1:
            left.append(text[at:begin])
            at = word.end()
            waiting.pop()
    return "".join([*left, text[at:]])


def _cut(rows: pa.RecordBatch, out: list[Judged]) -> pa.RecordBatch:
    """Rows with the spans cut out of ``text``."""
    if not any(j.spans for j in out):
        return rows
    columns = dict(zip(rows.schema.names, rows.columns))
    texts = columns["text"].to_pylist()
    kept = [without(t, j.spans) if j.spans else t for t, j in zip(texts, out)]
    columns["text"] = pa.array(kept, columns["text"].type)
    if "n_chars" in columns:
        sizes = [len(k) if j.spans and n is not None else n for n, k, j in zip(columns["n_chars"].to_pylist(), kept, out)]
        columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _found(docs: DataFrame, benchmark: DataFrame, width: int, shard_words: int, how: str) -> DataFrame:
    sent = blocks(benchmark, width)
    most = min(shard_words, MOST_WORDS)
    step = max(width, most - 1)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def answer(rows: pa.RecordBatch, out: list[Judged]) -> pa.RecordBatch:
        if how == "clean":
            return rows.filter(pa.array([not j.spans for j in out], pa.bool_()))
        if how == "drop":
            stays = [j.longest < width for j in out]
            rows, out = rows.filter(pa.array(stays, pa.bool_())), [j for j, s in zip(out, stays) if s]
        if how != "spans":
            return _cut(rows, out)
        return pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array([j.words for j in out], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in j.spans] for j in out], kind), pa.array([sorted(j.items) for j in out], pa.list_(pa.int64()))],
            ["doc_id", "n_words", "spans", "items"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # ``added``: for each text of the shard what it belongs to and its first word; ``pending``: for each row of ``held``
        shard, added, pending, held, seen = Shard(), [], [], [], {}

        def search():
            nonlocal shard, added, seen
            if added:
                for (judged, first), (starts, ends, items) in zip(added, shard.search(sent)):
                    judged.take(starts + first, ends + first, items)
            shard, added, seen = Shard(), [], {}

        def answers():
            nonlocal pending, held
            done = 0
            for rows in held:
                yield answer(rows, pending[done : done + rows.num_rows])
                done += rows.num_rows
            pending, held = [], []

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            first = 0
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                got = seen.get(text)
                if got is None:
                    got = Judged()
                    for start, words in pieces_of(text, step, width):
                        if shard.words >= most:
                            # the text goes on in a new shard; the rows before it are done
                            search()
                            if first < i:
                                held.append(batch.slice(first, i - first))
                                first = i
                            yield from answers()
                        shard.add(words)
                        added.append((got, start))
                        got.words = start + len(words)
                    seen[text] = got
                pending.append(got)
                if shard.words >= most:
                    held.append(batch.slice(first, i + 1 - first))
                    first = i + 1
                    search()
                    yield from answers()
            if first < batch.num_rows:
                held.append(batch.slice(first))
        if held:
            search()
            yield from answers()

    if how != "spans":
        return docs.mapInArrow(run, docs.schema)
    return id_and_text(docs).mapInArrow(run, SCHEMA)
