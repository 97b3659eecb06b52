"""Join of documents by the Jaccard similarity of their word shingles, with what sets have in common used to skip work.

Equal sets are one node. Any two sets of similarity t share a token among the first of each in a common order (rare
tokens first), so lists of these prefix tokens hold every candidate. Two kinds of work are skipped:

* *Lists* are kept by size and position and cut into blocks. Two sets can share no more than what stands before the
  token in both, the token, and what follows it in both; blocks whose sizes or positions leave too little for the
  overlap that is asked for are skipped without a look at their pairs (``fitting``).
* *Answers*: every list names a leader, first the most copied of its sets, and a set's similarity to the leader with
  which it shares most lists is computed. Sets linked with the same leader are linked with each other already. One
  more turn with several other leaders, for lists that are not of one class yet, leaves few sets outside; these are held
  against the classes they meet: only if they share as many lists with a class as a similar set must share
  with one of its members (``shared``), and then only against members that the leader's computed answers leave open
  (1 - similarity is a metric, so two sets that differ much in their distance from a leader are not similar).

Tokens are 64-bit hashes. The order needs only the frequent tokens, found by counters of bounded number over all rows;
any order gives the same result. Lists of frequent tokens are dealt out by size and number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import arrow_rows, id_and_text
from auditlake.llm.components import components
from auditlake.session import materialise

SHINGLE = 5
#: Least similarity, in per cent.
PERCENT = 80
#: Counters of frequent tokens of one task, which is also their greatest number in all (12 bytes each), and the least count of one.
COUNTERS = 1 << 17
LEAST_FREQUENT = 20
#: Tokens that are counted at a time.
BATCH = 1 << 22
#: Entries of a block of a list; homes of one part of a list; pairs of one leader that a task compares.
BLOCK = 128
HOMES = 20_000
PAIRS = 4096
#: Entries of a list that is compared together with others; sets and classes of a larger one that are held at a time.
SMALL = 16
CELLS = 1 << 20
#: Leaders that a set is compared with, by turn, before it is held against classes.
LEADERS = (1, 6)

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str) -> np.ndarray:
    """Sorted hashes of the distinct shingles of five words; fewer words are one shingle, none give none."""
    import xxhash

    words = text.encode("utf-8", "replace").translate(_FOLD).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(SHINGLE, len(words))
    many = len(words) - width + 1
    h = np.full(many, width, dtype=np.uint64)
    for k in range(width):
        h += w[k : k + many] * _FACTORS[k]
    return np.unique(_mixed(h))


def prefix_length(n: int) -> int:
    """Tokens of a set of ``n`` among which one is shared with every set that is similar enough."""
    return n - (PERCENT * n + 99) // 100 + 1 if n else 0


def enough(n, m):
    """Least overlap of similar sets of ``n`` and ``m`` tokens."""
    return (PERCENT * (n + m) + 99 + PERCENT) // (100 + PERCENT)


class Counters:
    """Counts of the most frequent tokens, COUNTERS at most; what overflows is taken off all alike."""

    def __init__(self, most: int = COUNTERS):
        self.most, self.tokens, self.counts = most, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def add(self, tokens: np.ndarray) -> None:
        """Count ``tokens``, which are sorted in place; a token seen once takes no memory beside it."""
        tokens.sort()
        same = tokens[1:] == tokens[:-1]
        several = np.append(False, same) | np.append(same, False) if len(tokens) else np.zeros(0, dtype=bool)
        once, repeated = len(tokens) - int(np.count_nonzero(several)), tokens[several]
        start, many = _edges(repeated)
        new = repeated[start]
        here = np.searchsorted(tokens, self.tokens, "right") - np.searchsorted(tokens, self.tokens)
        held, _ = _frequent_among(new, self.tokens)
        new, many = new[~held], many[~held]
        once -= int(np.count_nonzero(here == 1))
        counts = np.concatenate([self.counts + here, many])
        over = len(counts) + once - self.most
        if over > 0:
            ones = once + int(np.count_nonzero(counts == 1))
            counts -= 1 if over <= ones else np.partition(counts, over - 1 - once)[over - 1 - once]
            new = np.concatenate([self.tokens, new])
        else:
            single = tokens[~several]
            single = single[~_frequent_among(single, self.tokens)[0]]
            new, counts = np.concatenate([self.tokens, new, single]), np.concatenate([counts, np.ones(len(single), dtype=np.int64)])
        new, counts = new[counts > 0], counts[counts > 0]
        order = np.argsort(new)
        self.tokens, self.counts = new[order], counts[order]


def frequent(docs: DataFrame, most: int = COUNTERS, least: int = LEAST_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Frequent tokens of all texts in order of their hash, and their counts (lower bounds); ``most`` of them at most come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, waiting, filled = Counters(most), np.empty(BATCH, dtype=np.uint64), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                for text in batch.column(0).slice(lo, 1000).to_pylist():
                    tokens = shingles(text)
                    while len(tokens):
                        part = tokens[: BATCH - filled]
                        waiting[filled : filled + len(part)] = part
                        filled, tokens = filled + len(part), tokens[len(part) :]
                        if filled == BATCH:
                            own.add(waiting)
                            filled = 0
        own.add(waiting[:filled])
        many = own.counts > 1
        yield pa.RecordBatch.from_arrays([pa.array(own.tokens[many].view(np.int64)), pa.array(own.counts[many])], ["token", "count"])

    found = docs.select("text").mapInArrow(count, "token long, count long").groupBy("token").agg(F.sum("count").alias("count")).where(F.col("count") >= least)
    rows = found.orderBy(F.desc("count"), "token").limit(most).toPandas()
    tokens, counts = rows["token"].to_numpy(dtype=np.int64).view(np.uint64), rows["count"].to_numpy(dtype=np.int64)
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def _frequent_among(tokens: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each token is among the ``known`` ones, and where."""
    if not len(known):
        return np.zeros(len(tokens), dtype=bool), np.zeros(len(tokens), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    return known[at] == tokens, at


def prefix(tokens: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first tokens of a set: those not known to be frequent in order of their hash, then the others by their count."""
    length = prefix_length(len(tokens))
    hot, at = _frequent_among(tokens, known)
    first = tokens[~hot][:length]
    if len(first) < length:
        rest = tokens[hot]
        first = np.concatenate([first, rest[np.lexsort((rest, counts[at[hot]]))][: length - len(first)]])
    return first


def sets(docs: DataFrame, known) -> DataFrame:
    """doc_id, n, digest (of the set), prefix (its first tokens, packed) for each row; ``known`` is a broadcast of ``frequent``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for ids, texts in arrow_rows(batches, "doc_id", "text"):
            for lo in range(0, len(ids), 1000):
                found = [shingles(t) for t in texts[lo : lo + 1000]]
                columns = [
                    pa.array(ids[lo : lo + 1000], pa.int64()),
                    pa.array([len(s) for s in found], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()),
                    pa.array([prefix(s, *known.value).tobytes() for s in found], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "digest", "prefix"])

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, prefix binary")


def nodes(rows: DataFrame) -> DataFrame:
    """One row for each distinct set: digest, doc (its smallest doc_id), n, prefix, node. The more copies a set has, the smaller its node's number (by powers of two)."""
    one = rows.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    rank = (60 - F.floor(F.log2(F.col("copies").cast("double")))).cast("long")
    return materialise(one.withColumn("node", F.shiftleft(rank, 55) + F.monotonically_increasing_id()), "nodes")


#: ``place`` packs size (upper half), a bit for visitors, and position (lowest 31 bits) of an entry.
AWAY = 1 << 31


def entries(found: DataFrame, known, homes: int = HOMES) -> DataFrame:
    """list, node, place: an entry for each prefix token of each node.

    The list of a frequent token is dealt out: a set is at home in the part of its size band and number, and visits the
    parts of its own and the next lower band (a similar set is at most 100 / PERCENT as large, so at most one band off).
    """
    ratio = np.log(100 / PERCENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = known.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                node, n, packed = (part.column(part.schema.get_field_index(c)) for c in ("node", "n", "prefix"))
                node, n, packed = node.to_numpy(), n.to_numpy(), [np.frombuffer(p, dtype=np.uint64) for p in packed.to_pylist()]
                many = np.array([len(p) for p in packed], dtype=np.int64)
                who = np.repeat(np.arange(len(packed)), many)
                place = (n[who] << 32) | (np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many))
                key = np.concatenate(packed) if packed else np.zeros(0, dtype=np.uint64)
                hot, at = _frequent_among(key, tokens)
                out = [(key[~hot], node[who[~hot]], place[~hot])]
                if hot.any():
                    band = np.floor(np.log(n[who[hot]]) / ratio + 1e-9).astype(np.int64)
                    parts = -(-counts[at[hot]] // homes)
                    own = _mixed(node[who[hot]].view(np.uint64)) % parts.astype(np.uint64)
                    for down in (0, 1):
                        for k in range(int(parts.max())):
                            here = k < parts
                            salted = _mixed(key[hot][here] + _mixed(((band[here] - down + 1) * 1_000_003 + k).astype(np.uint64)))
                            away = (own[here] != k) | bool(down)
                            out.append((salted, node[who[hot]][here], place[hot][here] | np.where(away, AWAY, 0)))
                key, who_, place = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(who_), pa.array(place)], ["list", "node", "place"])

    return found.select("node", "n", "prefix").mapInArrow(run, "list long, node long, place long")


def shared(n, m):
    """Least number of prefix tokens that similar sets of ``n`` and ``m`` tokens have in common.

    Of the common tokens all up to the end of the prefix that ends first are in both prefixes; the rest follow it.
    """
    length = lambda x: x - (PERCENT * x + 99) // 100 + 1
    return np.maximum(1, enough(n, m) - np.maximum(n - length(n), m - length(m)))


def fitting(n: np.ndarray, pos: np.ndarray, away: np.ndarray, label: np.ndarray | None = None, lo: int = 0, hi: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of entries of one list, in order of size, that may be similar; block by block, with blocks skipped by size and position.

    Pairs of one ``label`` are left out, and so are blocks neither of which starts in ``lo`` to ``hi``.
    """
    rest, starts = n - pos, range(0, len(n), BLOCK)
    low, high = [int(n[s]) for s in starts], [int(n[min(s + BLOCK, len(n)) - 1]) for s in starts]
    behind, before = [int(rest[s : s + BLOCK].max()) for s in starts], [int(pos[s : s + BLOCK].max()) for s in starts]
    wanted = [lo <= s < (len(n) if hi is None else hi) for s in starts]
    for a, s in enumerate(starts):
        for b in range(a, len(low)):
            if PERCENT * low[b] > 100 * high[a]:
                break
            if not (wanted[a] or wanted[b]) or min(before[a], before[b]) + min(behind[a], behind[b]) < enough(low[a], low[b]):
                continue
            t = b * BLOCK
            x, y = slice(s, s + BLOCK), slice(t, t + BLOCK)
            fit = np.minimum(pos[x, None], pos[None, y]) + np.minimum(rest[x, None], rest[None, y]) >= enough(n[x, None], n[None, y])
            fit &= PERCENT * n[None, y] <= 100 * n[x, None]
            fit &= ~(away[x, None] & away[None, y])
            if label is not None:
                fit &= label[x, None] != label[None, y]
            if a == b:
                fit = np.triu(fit, 1)
            i, j = np.nonzero(fit)
            if len(i):
                yield i + s, j + t


def _in_small(start: np.ndarray, size: np.ndarray, n: np.ndarray, pos: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ``fitting`` of all lists of SMALL entries at most together, at once."""
    pairs = [(start[size == m][:, None] + np.stack(np.triu_indices(m, 1))[:, None, :]).reshape(2, -1) for m in range(2, SMALL + 1)]
    i, j = np.concatenate(pairs, axis=1)
    fit = (np.minimum(pos[i], pos[j]) + np.minimum((n - pos)[i], (n - pos)[j]) >= enough(n[i], n[j])) & (PERCENT * np.maximum(n[i], n[j]) <= 100 * np.minimum(n[i], n[j])) & ~(away[i] & away[j])
    return i[fit], j[fit]


def _lists(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """Whole lists of rows sorted by list, several at a time: the named columns as arrays."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns]
        if held and rows[0][-1] == held[0][0][-1]:  # still the same list
            held.append(rows)
            continue
        first = int(np.searchsorted(rows[0], rows[0][-1]))
        held.append([r[:first] for r in rows])
        yield [np.concatenate(c) for c in zip(*held)]
        held = [[r[first:] for r in rows]]
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _edges(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    return start, np.diff(np.append(start, len(key)))


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 32, place & (AWAY - 1), (place & AWAY) != 0


def partnered(listed: DataFrame) -> DataFrame:
    """The entries that have a partner in their list: list, node, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, place in _lists(batches, ["list", "node", "place"]):
            n, pos, away = _unpack(place)
            start, size = _edges(key)
            kept = np.zeros(len(key), dtype=bool)
            i, j = _in_small(start, size, n, pos, away)
            kept[i] = kept[j] = True
            for s, m in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
                order = s + np.lexsort((pos[s : s + m], n[s : s + m]))
                for i, j in fitting(n[order], pos[order], away[order]):
                    kept[order[i]] = kept[order[j]] = True
            if kept.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[kept]), pa.array(node[kept]), pa.array(place[kept])], ["list", "node", "place"])

    return listed.repartition("list").sortWithinPartitions("list").mapInArrow(run, "list long, node long, place long")


def _by_list(rooted: DataFrame) -> DataFrame:
    return rooted.repartition("list").sortWithinPartitions("list")


def unsettled(rooted: DataFrame) -> DataFrame:
    """The lists (list, node, place, root) whose entries are not all of one class yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _lists(batches, ["list", "node", "place", "root"]):
            start, size = _edges(columns[0])
            kept = np.repeat(np.maximum.reduceat(columns[3], start) != np.minimum.reduceat(columns[3], start), size)
            if kept.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in columns], ["list", "node", "place", "root"])

    return _by_list(rooted).mapInArrow(run, "list long, node long, place long, root long")


def leader_pairs(rooted: DataFrame, turn: int, done: DataFrame | None) -> DataFrame:
    """Pairs (a, b) of a leader and a set of another class: for each set the leaders of most of its lists, if these are half as many as similar sets must share.

    The leaders of a list are the least of its sets, by number in the first turn and by a hash of its own in the others;
    how many, ``LEADERS`` says, of a list as of a set. Pairs of ``done`` (a, b) are left out.
    """
    leaders = LEADERS[turn]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _lists(batches, ["list", "node", "place", "root"]):
            order = columns[1] if turn == 0 else _mixed(columns[1].view(np.uint64) + np.uint64(turn)).view(np.int64)
            key, node, place, root = (c[np.lexsort((order, columns[0]))] for c in columns)
            n, _, _ = _unpack(place)
            start, size = _edges(key)
            for k in range(leaders):
                lead = np.repeat(start + np.minimum(k, size - 1), size)
                kept = (np.repeat(size, size) > k) & (root != root[lead]) & (PERCENT * np.maximum(n, n[lead]) <= 100 * np.minimum(n, n[lead]))
                if kept.any():
                    at = lead[kept]
                    yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[kept]), pa.array(shared(n[kept], n[at]))], ["a", "b", "need"])

    met = _by_list(rooted).mapInArrow(run, "a long, b long, need long").groupBy("a", "b", "need").agg(F.count("*").alias("many")).where("2 * many >= need")
    if done is not None:
        met = met.join(done.select("a", "b"), ["a", "b"], "left_anti")
    if leaders == 1:
        best = met.groupBy("b").agg(F.max(F.struct("many", (-F.col("a")).alias("leader"))).alias("best"))
        return best.select((-F.col("best.leader")).alias("a"), "b")
    nth = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("many"), "a"))
    return met.withColumn("nth", nth).where(F.col("nth") <= leaders).select("a", "b")


def _met(i: np.ndarray, j: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What pairs of a list must share at least, and whether this list's token may be the first they share: two similar sets have all they share from there on."""
    return shared(n[i], n[j]), np.minimum(n[i] - pos[i], n[j] - pos[j]) >= enough(n[i], n[j])


def _upward(i: np.ndarray, j: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up = root[i] > root[j]
    return np.where(up, i, j), np.where(up, j, i)


def _classes_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each list, set and class of a lower number that it meets there: node, class, need, opens.

    Lists of SMALL entries are taken together. Of a larger one CELLS sets and classes are held at a time, in two arrays.
    """

    def out(node: np.ndarray, root: np.ndarray, need: np.ndarray, opens: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), pa.array(need), pa.array(opens)], ["node", "class", "need", "opens"])

    none = np.iinfo(np.int64).max
    for key, node, place, root in _lists(batches, ["list", "node", "place", "root"]):
        n, pos, away = _unpack(place)
        start, size = _edges(key)
        several = np.maximum.reduceat(root, start) != np.minimum.reduceat(root, start)
        start, size = start[several], size[several]
        i, j = _in_small(start, size, n, pos, away)
        i, j = _upward(*(x[root[i] != root[j]] for x in (i, j)), root)
        if len(i):
            need, opens = _met(i, j, n, pos)
            order = np.lexsort((root[j], i))
            i, other, need, opens = i[order], root[j][order], need[order], opens[order]
            new = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (other[1:] != other[:-1])))
            yield out(node[i[new]], other[new], np.minimum.reduceat(need, new), np.logical_or.reduceat(opens, new))
        for s, m in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
            order = s + np.lexsort((pos[s : s + m], n[s : s + m]))
            names, label = np.unique(root[order], return_inverse=True)
            sizes, places, visits = n[order], pos[order], away[order]
            band = max(1, CELLS // (len(names) * BLOCK)) * BLOCK
            for lo in range(0, m, band):
                hi = min(m, lo + band)
                need, opens = np.full((hi - lo) * len(names), none), np.zeros((hi - lo) * len(names), dtype=bool)
                for i, j in fitting(sizes, places, visits, label, lo, hi):
                    i, j = _upward(i, j, label)
                    i, j = (x[(i >= lo) & (i < hi)] for x in (i, j))
                    cell = (i - lo) * len(names) + label[j]
                    least, first = _met(i, j, sizes, places)
                    np.minimum.at(need, cell, least)
                    opens[cell[first]] = True
                found = np.flatnonzero(need < none)
                if len(found):
                    yield out(node[order[lo + found // len(names)]], names[found % len(names)], need[found], opens[found])


def open_classes(rooted: DataFrame) -> DataFrame:
    """(node, class): sets that share as many lists with a class of a lower number as they must with a similar member of it."""
    met = _by_list(rooted).mapInArrow(_classes_met, "node long, class long, need long, opens boolean")
    return met.groupBy("node", "class").agg(F.count("*").alias("many"), F.min("need").alias("need"), F.max("opens").alias("opens")).where("many >= need and opens").select("node", "class")


def open_pairs(rooted: DataFrame, found: DataFrame, roots: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets and members of the classes they are open to, less those that sizes or the members' first leader rule out, and those of ``done``."""
    sized = found.select("node", "n")
    members = sized.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(F.col("node").alias("b"), F.col("n").alias("m"), F.coalesce("root", "node").alias("class"))
    pairs = open_classes(rooted).join(members, "class").join(sized, "node").where(F.lit(PERCENT) * F.greatest("n", "m") <= 100 * F.least("n", "m")).select(F.col("node").alias("a"), "b")
    first = done.where("turn = 0").select(F.col("b"), F.col("a").alias("leader"), F.col("near").alias("its"))
    known = done.select(F.col("a").alias("leader"), F.col("b").alias("a"), F.col("near").alias("own"))
    far = F.abs(F.col("own") - F.col("its")) > (100 - PERCENT) / 100 + 1e-9
    open_ = pairs.join(first, "b", "left").join(known, ["leader", "a"], "left").where(~F.coalesce(far, F.lit(False)))
    return open_.select("a", "b").join(done.select(F.col("a"), F.col("b")), ["a", "b"], "left_anti").distinct()


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, tokens (packed) for the nodes ``wanted`` (node, doc, digest), made again from the texts. A text in several rows of its ``doc_id`` may come several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for node, digest, texts in arrow_rows(batches, "node", "digest", "text"):
            rows = list({(k, t): (k, d, t) for k, d, t in zip(node, digest, texts)}.values())
            for lo in range(0, len(rows), 500):
                made = [(k, s) for k, d, s in ((k, d, shingles(t)) for k, d, t in rows[lo : lo + 500]) if xxhash.xxh3_128_digest(s.tobytes()) == d]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.int64()), pa.array([s.tobytes() for _, s in made], pa.binary())], ["node", "tokens"])

    return docs.join(wanted, F.col("doc_id") == F.col("doc")).select("node", "digest", "text").mapInArrow(run, "node long, tokens binary")


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by a and part, a's own set first: a, b, similarity, whether it is enough."""
    own = None
    for batch in batches:
        a, b, tokens = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "tokens"))
        out = []
        for x, y, packed in zip(a.to_pylist(), b.to_pylist(), tokens):
            s = np.frombuffer(packed.as_buffer(), dtype=np.uint64)
            if y is None:
                own = s.copy()
                continue
            at = np.minimum(np.searchsorted(own, s), len(own) - 1)
            both = int(np.count_nonzero(own[at] == s))
            union = len(own) + len(s) - both
            out.append((x, y, both / union, 100 * both >= PERCENT * union))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], ["a", "b", "near", "linked"])


def compare(pairs: DataFrame, docs: DataFrame, found: DataFrame) -> DataFrame:
    """Similarity of each pair (a, b) of nodes: a, b, near, linked. A set's partners are compared in parts of PAIRS at most, on average."""
    pairs = materialise(pairs, "pairs")
    many = pairs.groupBy("a").count().where(F.col("count") > PAIRS).select(F.col("a").alias("_a"), F.ceil(F.col("count") / PAIRS).alias("_parts"))
    dealt = pairs.join(many, F.col("a") == F.col("_a"), "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("_parts", F.lit(1))).alias("part"))
    owns = dealt.select("a", "part").distinct().select(F.col("a").alias("_node"), "a", "part", F.lit(None).cast("long").alias("b"))
    places = owns.union(dealt.select("b", "a", "part", "b"))
    wanted = found.join(places.select("_node").distinct(), F.col("node") == F.col("_node")).select("node", "doc", "digest")
    rows = whole_sets(docs, wanted).join(places, F.col("node") == F.col("_node")).select("a", "part", "b", "tokens")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return materialise(rows.mapInArrow(_overlaps, "a long, b long, near double, linked boolean"), "compared")


def _linked(compared: DataFrame) -> DataFrame:
    return compared.where("linked").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))


def classes(docs: DataFrame, homes: int = HOMES, most: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest ``doc_id`` that links reach.

    A text without words (null, empty, white space) has an empty set, is linked with nothing and is its own class.
    Repeated rows stay, each with the class of its text. A row without ``doc_id`` gets the class of its set but is
    nobody's smallest id and links no others; where no row with this set has an id, the class is null. Columns other
    than ``doc_id`` and ``text`` play no part. An empty table has no rows.
    """
    context = docs.sparkSession.sparkContext
    texts = id_and_text(docs)
    known = context.broadcast(frequent(texts, most))
    rows = materialise(sets(texts, known), "rows")
    found = nodes(rows)
    rooted = materialise(partnered(entries(found, known, homes)), "lists").withColumn("root", F.col("node"))
    done, roots = None, None
    for turn in range(len(LEADERS)):
        new = compare(leader_pairs(rooted, turn, done), texts, found).withColumn("turn", F.lit(turn))
        done = new if done is None else done.unionByName(new)
        roots = materialise(components(_linked(done)), "roots")
        again = rooted.drop("root").join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("list", "node", "place", F.coalesce("root", "node").alias("root"))
        rooted = materialise(unsettled(again), "unsettled")
    last = compare(open_pairs(rooted, found, roots, done), texts, found)
    roots = components(_linked(done).union(_linked(last)))
    named = found.select("digest", "doc", "node").join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("digest", "doc", F.coalesce("root", "node").alias("root"))
    least = named.groupBy(F.col("root").alias("_root")).agg(F.min("doc").alias("component"))
    named = named.join(least, F.col("root") == F.col("_root")).select(F.col("digest").alias("_digest"), "component")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return rows.select("doc_id", "n", "digest").join(named, F.col("digest") == F.col("_digest"), "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
