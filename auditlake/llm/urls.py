"""URL filter over sorted arrays of rule digests.

The rules' 64-bit digests lie sorted in arrays that executors map into memory from a local file (unlinked as soon as it
is mapped, so nothing stays behind). For each URL the digests of all host suffixes with all path prefixes of the lengths
that occur among the rules are probed at once by binary search; a hit counts only if the stored rule string is the
candidate's, so digests that collide do no harm. A list of any size is cut into slices of bounded size, which
are sent one by one; an executor has them on disk and maps them.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import arrow_rows
from auditlake.session import materialise

#: Bytes of rule strings in one slice.
SLICE_BYTES = 32_000_000
ALLOW, BLOCK = "allow", "block"

_FOLD = {c: c + 32 for c in range(65, 91)}


def parse(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL: what stands between ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case, and what follows up to ``?`` or ``#``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    at = rest.find("/")
    host, path = (rest, "") if at < 0 else (rest[:at], rest[at:])
    return host.translate(_FOLD), path


def parse_rule(rule: str) -> tuple[str, str]:
    """(host, path) of a rule such as ``example.com/en/``; a rule without a slash has an empty path."""
    at = rule.find("/")
    return (rule.translate(_FOLD), "") if at < 0 else (rule[:at].translate(_FOLD), rule[at:])


def digest(host: str, path: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{host}\0{path}".encode("utf-8", "replace"))


class Digests:
    """One slice: sorted digests, the rule string and whether it blocks, in one block of bytes that can be mapped."""

    def __init__(self, rules: list[tuple[str, bool]]):
        keyed = sorted((digest(*parse_rule(r)), r.encode(), block) for r, block in rules)
        ends = np.cumsum([0, *(len(r) for _, r, _ in keyed)]).astype("<i8")
        parts = [np.array([k for k, _, _ in keyed], dtype="<u8"), ends, np.frombuffer(b"".join(r for _, r, _ in keyed), dtype=np.uint8), np.array([b for _, _, b in keyed], dtype=np.uint8)]
        self.count, self.data = len(keyed), b"".join(p.tobytes() for p in parts)


class Mapped:
    """A slice mapped from a file of the executor's own."""

    def __init__(self, digests: Digests):
        handle, name = tempfile.mkstemp(prefix="rules-")
        with os.fdopen(handle, "wb") as file:
            file.write(digests.data)
        n, whole = digests.count, np.memmap(name, dtype=np.uint8, mode="r")
        os.unlink(name)
        self.keys = whole[: 8 * n].view("<u8")
        self.ends = whole[8 * n : 16 * n + 8].view("<i8")
        self.text = whole[16 * n + 8 : len(whole) - n]
        self.blocks = whole[len(whole) - n :]

    def rule(self, i: int) -> str:
        return bytes(self.text[self.ends[i] : self.ends[i + 1]]).decode()


def slices(rules: DataFrame, most: int = SLICE_BYTES) -> tuple[list, list[int]]:
    """The rules (``rule``, ``action``) as broadcast slices of about ``most`` bytes at most, and the lengths of the rules' paths.

    Rows without a rule or with another action than allow or block are left out; of a rule given with both actions, block holds.
    """
    context = rules.sparkSession.sparkContext
    plain = rules.where(F.col("action").isin(ALLOW, BLOCK) & F.col("rule").isNotNull()).groupBy(F.col("rule").cast("string").alias("rule")).agg(F.max(F.col("action") == BLOCK).alias("blocks"))
    plain = materialise(plain, "url-rules")
    at = F.instr("rule", "/")
    lengths = [r[0] for r in plain.select(F.when(at == 0, 0).otherwise(F.char_length("rule") - at + 1).alias("n")).distinct().collect()]
    size = plain.agg(F.sum(F.octet_length("rule") + 24)).first()[0] or 0
    count, sent = -(-size // most), []
    for k in range(count):
        part = plain if count == 1 else plain.where(F.pmod(F.xxhash64("rule"), F.lit(count)) == k)
        rows = [(r.rule, r.blocks) for r in part.toLocalIterator()]
        if rows:
            sent.append(context.broadcast(Digests(rows)))
    return sent, sorted(lengths)


def match(found: list[tuple[str, str]], mapped: list[Mapped], lengths: list[int]) -> list[tuple[str, bool] | None]:
    """For each (host, path) the longest rule that fits and whether it blocks; of equally long ones that of the longer host."""
    owner, wanted, keys = [], [], []
    for i, (host, path) in enumerate(found):
        hosts, at = [host], host.find(".")
        while at >= 0:
            hosts.append(host[at + 1 :])
            at = host.find(".", at + 1)
        for h in hosts:
            for n in lengths:
                if n > len(path):
                    break
                owner.append(i)
                wanted.append((h, path[:n]))
                keys.append(digest(h, path[:n]))
    best: list = [None] * len(found)
    probe = np.array(keys, dtype=np.uint64)
    for array in mapped:
        lo, hi = np.searchsorted(array.keys, probe, side="left"), np.searchsorted(array.keys, probe, side="right")
        for j in np.flatnonzero(hi > lo).tolist():
            for at in range(int(lo[j]), int(hi[j])):
                rule = array.rule(at)
                host, path = parse_rule(rule)
                if (host, path) == wanted[j]:
                    rank, blocks = (len(host) + len(path), len(host)), bool(array.blocks[at])
                    held = best[owner[j]]
                    # rules that differ in the case of their hosts alone are one rule: block holds, then the smaller string
                    if held is None or (rank, blocks, held[2]) > (held[0], held[1], rule):
                        best[owner[j]] = (rank, blocks, rule)
    return [b and (b[2], b[1]) for b in best]


def judge(pages: DataFrame, rules: DataFrame, default: str = ALLOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per row of ``pages`` (``page_id``, ``url``): ``page_id``, ``host``, ``path``, ``rule`` (null if none fits), ``verdict``.

    A null URL and one without ``://`` have an empty host and path. Where no rule fits, the verdict is ``default``. A null
    ``page_id`` stays; repeated rows stay; without rules every page gets the default; an empty table gives no rows.
    """
    sent, lengths = slices(rules, slice_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = [Mapped(s.value) for s in sent]
        for ids, urls in arrow_rows(batches, "page_id", "url"):
            found = [parse(u) for u in urls]
            got = match(found, mapped, lengths)
            columns = [pa.array(ids, pa.int64()), *(pa.array(x, pa.string()) for x in zip(*found)), pa.array([g and g[0] for g in got], pa.string()), pa.array([(BLOCK if g[1] else ALLOW) if g else default for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
