"""Token counts by a linear longest-match automaton.

A word is cut greedily: the longest vocabulary piece at its start, then the longest continuation piece at what is left,
and so on; a word that cannot be cut so to its end counts as one unknown token. The automaton is a trie of the pieces
with failure links: where no edge goes on, the link leads to the node for what is left after the pieces that greedy
cutting would have taken so far, and tells how many pieces those were. Counting thus reads every character once and
builds no piece. Words are counted once per worker where they repeat.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from auditlake.llm.common import arrow_rows, id_and_text

#: Words whose counts a worker keeps, and the longest such word.
KEPT_WORDS = 500_000
KEPT_CHARS = 64
FAIL = -1


class Automaton:
    """Trie over word-initial pieces (from node 0) and continuation pieces (from node 1), with failure links and counts of pieces popped on them."""

    def __init__(self, initial: Iterable[str], following: Iterable[str]):
        self.edges: list[dict[str, int]] = [{}, {}]
        piece = [False, False]
        for root, pieces in ((0, initial), (1, following)):
            for text in pieces:
                node = root
                for c in text:
                    if c not in self.edges[node]:
                        self.edges[node][c] = len(self.edges)
                        self.edges.append({})
                        piece.append(False)
                    node = self.edges[node][c]
                if text:
                    piece[node] = True
        size = len(self.edges)
        self.link, self.popped = [FAIL] * size, [0] * size
        # breadth first: a node's link comes from its parent's, which leads to shorter texts
        level = [0, 1]
        while level:
            deeper = []
            for node in level:
                for c, child in self.edges[node].items():
                    deeper.append(child)
                    if piece[child]:
                        # the whole text from the root is one piece; nothing is left
                        self.link[child], self.popped[child] = 1, 1
                        continue
                    at, popped = self.link[node], self.popped[node]
                    while at != FAIL and c not in self.edges[at]:
                        popped += self.popped[at]
                        at = self.link[at]
                    if at != FAIL:
                        self.link[child], self.popped[child] = self.edges[at][c], popped
            level = deeper

    def count(self, word: str) -> int:
        """Pieces of the greedy cut; 0 if there is none. An empty word has none."""
        node, count, edges = 0, 0, self.edges
        for c in word:
            while c not in edges[node]:
                count += self.popped[node]
                node = self.link[node]
                if node == FAIL:
                    return 0
            node = edges[node][c]
        # what is left must be cut to its end
        while node > 1:
            count += self.popped[node]
            node = self.link[node]
            if node == FAIL:
                return 0
        return count


def pieces_of(path: str) -> tuple[list[str], list[str]]:
    """Word-initial and continuation pieces of a sentence-piece vocabulary file; marked pieces start words. Bytes and special pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    names = [model.id_to_piece(i) for i in ids]
    return [n[1:] for n in names if n[0] == "▁" and "▁" not in n[1:] and len(n) > 1], [n for n in names if "▁" not in n]


class Counter:
    def __init__(self, path: str):
        self.automaton = Automaton(*pieces_of(path))
        self.kept: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = self.automaton.count(word)
        if len(word) <= KEPT_CHARS:
            if len(self.kept) >= KEPT_WORDS:
                self.kept.clear()
            self.kept[word] = n
        return n

    def text(self, text: str) -> tuple[int, int, int]:
        """(words, tokens, unknown words)"""
        words = split(text)
        kept, one = self.kept, self.word
        counts = [kept[w] if w in kept else one(w) for w in words]
        unknown = counts.count(0)
        return len(words), sum(counts) + unknown, unknown



def split(text: str) -> list[str]:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    for c in "\t\n\x0b\x0c\r":
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_tokens``, ``n_unknown`` (words that count as one unknown token).

    A null or empty text has none; a null ``doc_id`` stays; repeated rows stay; an empty table gives no rows. ``path``
    is the vocabulary file's place on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path)
        own = _COUNTERS[path]
        for ids, texts in arrow_rows(batches, "doc_id", "text"):
            rows = [own.text(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*rows))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
