"""Byte-level BPE with reuse of content-defined chunks.

A rolling hash over the code points cuts each text into chunks; where the hash cuts depends on the 16 characters
before the cut alone, so a passage that several documents share is cut alike in all of them. A chunk is encoded
once per worker and then found again by its text. The cut may lie inside a token: a chunk therefore keeps the
ids of its inner part and, as text, its two ends. The inner part reaches from the first to the last *agreed*
boundary, a single space between two characters that are not white space, where the tokenizer always starts a new
piece whatever stands further away. At a join both ends are put together and encoded anew; the ids left and right
of the two agreed boundaries then are those of the whole text, so the result is that of encoding the whole text.

Reuse is per worker, in a store of bounded size that outlives the task: a corpus-wide table of chunk ids would have
to be shuffled to the documents and is larger than the texts (see README).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from auditlake.llm.common import arrow_rows, id_and_text

#: Mean chunk length in characters (a power of two) and the least distance of two cuts.
CHUNK_CHARS = 512
LEAST_CHARS = 64
#: Bounds of the worker's stores: entries of single pieces, characters of chunks.
PIECES = 400_000
STORED_CHARS = 8_000_000

# Below this code point the two public libraries agree on letters, numbers and white space (tested).
_AGREED_BELOW = 0x370
_ODD = re.compile(r" \s|\s ")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_MUL = np.uint32(0x9E3779B1)


def cuts(text: str, mean: int = CHUNK_CHARS, least: int = LEAST_CHARS) -> list[int]:
    """Positions at which the rolling hash of the 16 characters before them ends a chunk."""
    code = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    if len(code) <= 2 * least:
        return []
    mixed, factor = code * _MUL, np.uint32(0x01000193)
    for step in (1, 2, 4, 8):
        wider = mixed.copy()
        wider[step:] += mixed[:-step] * factor
        mixed, factor = wider, np.uint32(int(factor) * int(factor) & 0xFFFFFFFF)
    found = np.flatnonzero((mixed * _MUL) >> np.uint32(33 - mean.bit_length()) == 0) + 1
    out, last = [], 0
    for at in found.tolist():
        if at - last >= least and at < len(code):
            out.append(at)
            last = at
    return out


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable bytes are themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file, with the worker's stores."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte = byte_of_symbol()
        self.exact = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.bytes_of = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in self.special.items()}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.quick = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pieces: dict[str, list[int]] = {}
        self.chunks: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.stored = 0

    def piece(self, text: str) -> list[int]:
        """Ids of a text that stands between two agreed boundaries and holds none itself."""
        got = self.pieces.get(text)
        if got is None:
            if text.isascii() or max(text) < chr(_AGREED_BELOW):
                got = self.quick.encode_ordinary(text)
            else:
                got = self.exact.encode(text, add_special_tokens=False).ids
            if len(text) <= 64:
                if len(self.pieces) >= PIECES:
                    self.pieces.clear()
                self.pieces[text] = got
        return got

    def span(self, text: str) -> list[int]:
        """Ids of a text that starts and ends at agreed boundaries."""
        out: list[int] = []
        for p in parts(text):
            out += self.piece(p)
        return out

    def chunk(self, text: str) -> tuple:
        """(head, inner ids, tail), or (text,) for a chunk without an agreed boundary."""
        got = self.chunks.get(text) or self.older.pop(text, None)
        if got is None:
            cut = parts(text)
            if len(cut) < 2:
                got = (text,)
            else:
                inner: list[int] = []
                for p in cut[1:-1]:
                    inner += self.piece(p)
                got = (cut[0], inner, cut[-1])
        elif text in self.chunks:
            return got
        if self.stored + len(text) > STORED_CHARS // 2:
            self.older, self.chunks, self.stored = self.chunks, {}, 0
        self.chunks[text] = got
        self.stored += len(text)
        return got

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.split_special.split(text) if self.split_special else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            open_end, start = "", 0
            for end in [*cuts(part), len(part)]:
                got = self.chunk(part[start:end])
                start = end
                if len(got) == 1:
                    open_end += got[0]
                else:
                    out += self.span(open_end + got[0])
                    out += got[1]
                    open_end = got[2]
            out += self.span(open_end)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def parts(text: str) -> list[str]:
    """The text cut before each single space that stands between two characters other than white space."""
    if not text:
        return []
    if _ODD.search(text) or text[0] == " " or text[-1] == " ":
        out, last = [], 0
        for m in _SAFE.finditer(text):
            out.append(text[last : m.start()])
            last = m.start()
        return [*out, text[last:]]
    first, *rest = text.split(" ")
    return [first, *[" " + p for p in rest]]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a vocabulary file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, path: str, decoded: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``ids`` (array of int) and, if asked for, ``decoded``, the text decoded from them.

    A null text is empty and has no ids; a null ``doc_id`` stays; repeated rows stay; an empty table gives none. Texts
    are encoded whole, at any length. The special strings of the vocabulary are single tokens, as in the public library.
    ``path`` is the vocabulary file's place on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for doc_ids, texts in arrow_rows(batches, "doc_id", "text"):
            for lo in range(0, len(texts), 256):
                ids = [own.encode(t) for t in texts[lo : lo + 256]]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(ends[-1]))
                columns = [pa.array(doc_ids[lo : lo + 256], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                names = ["doc_id", "ids"]
                if decoded:
                    columns.append(pa.array([own.decode(x) for x in ids], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>" + (", decoded string" if decoded else ""))
