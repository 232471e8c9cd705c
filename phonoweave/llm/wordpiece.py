"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie. Each node has a failure link, taken when no edge fits the next symbol, and the number of tokens
that taking the link pops; so a word is read once, symbol by symbol, and its pieces are counted without being built. A
failure link may lead to another vocabulary, that of pieces inside a word (`continuation`, such as "##").

Null and empty texts have no words and no tokens. A word with a symbol outside the vocabulary counts as one token, as
word-piece encoders emit one unknown token for it, and is counted in n_unknown. Repeated rows are rows of their own.
Null ids stay null, an empty table gives no rows, other columns are not read.
"""

from __future__ import annotations

import itertools
import json
from collections import deque
from collections.abc import Iterable, Sequence

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonoweave.llm.common import small_batches

UNKNOWN = -1


class LongestMatch:
    """vocabulary: symbol sequences at the start of a word (first) and inside it (inner); equal where there is no difference."""

    def __init__(self, first: Iterable[Sequence[int]], inner: Iterable[Sequence[int]] | None = None):
        self.edges: list[dict[int, int]] = [{}]
        final = [False]

        def grow(root: int, tokens: Iterable[Sequence[int]]) -> None:
            for token in tokens:
                u = root
                for symbol in token:
                    v = self.edges[u].get(symbol)
                    if v is None:
                        v = self.edges[u][symbol] = len(self.edges)
                        self.edges.append({})
                        final.append(False)
                    u = v
                if u != root:
                    final[u] = True

        grow(0, first)
        self.inner = 0
        if inner is not None:
            self.inner = len(self.edges)
            self.edges.append({})
            final.append(False)
            grow(self.inner, inner)
        self.link = [UNKNOWN] * len(self.edges)
        self.popped = [0] * len(self.edges)
        queue = deque({0, self.inner})
        while queue:  # breadth first: links lead to nodes that are done
            u = queue.popleft()
            for symbol, v in self.edges[u].items():
                if final[v]:
                    self.link[v], self.popped[v] = self.inner, 1
                else:
                    z, n = self.link[u], self.popped[u]
                    while z != UNKNOWN and symbol not in self.edges[z]:
                        n, z = n + self.popped[z], self.link[z]
                    if z != UNKNOWN:
                        self.link[v], self.popped[v] = self.edges[z][symbol], n
                queue.append(v)

    def count(self, symbols: Iterable[int]) -> int:
        """Tokens of one word, or -1 if it can't be built from the vocabulary."""
        edges, link, popped = self.edges, self.link, self.popped
        u, n = 0, 0
        for symbol in symbols:
            v = edges[u].get(symbol)
            while v is None:
                n += popped[u]
                u = link[u]
                if u < 0:
                    return UNKNOWN
                v = edges[u].get(symbol)
            u = v
        while u != self.inner and u != 0:
            n += popped[u]
            u = link[u]
            if u < 0:
                return UNKNOWN
        return n


def byte_symbols() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write bytes with, by the public rule."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_vocabulary(path: str, mark: str = "</w>") -> set[bytes]:
    """The pieces of a byte-level tokenizers file as bytes, without the mark that ends words; all single bytes are among them."""
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    known = byte_symbols()
    bodies = (name.removesuffix(mark) for name in names)
    return {bytes(known[c] for c in body) for body in bodies if all(c in known for c in body)}


class WordCounter:
    """Counts whole texts; words already seen are kept, up to a bound."""

    WORD = regex.compile(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, automaton: LongestMatch, most: int = 400_000):
        self.automaton, self.most = automaton, most
        self.seen: dict[str, tuple[int, int, int]] = {}

    def chunk(self, chunk: str) -> tuple[int, int, int]:
        low = chunk.lower()
        words = [low] if low.isalpha() else self.WORD.findall(low)
        counts = [self.automaton.count(w.encode("utf-8", "surrogatepass")) for w in words]
        return len(words), sum(c if c >= 0 else 1 for c in counts), sum(c < 0 for c in counts)

    def count(self, text: str | None) -> tuple[int, int, int]:
        """Words, tokens, unknown words."""
        n = tokens = unknown = 0
        seen = self.seen
        for chunk in (text or "").split():
            got = seen.get(chunk)
            if got is None:
                got = self.chunk(chunk)
                if len(seen) >= self.most:  # the first seen are the most frequent
                    seen = self.seen = dict(itertools.islice(seen.items(), self.most // 2))
                if len(chunk) <= 64:
                    seen[chunk] = got
            n, tokens, unknown = n + got[0], tokens + got[1], unknown + got[2]
        return n, tokens, unknown


_AUTOMATA: dict[str, LongestMatch] = {}


def _automaton(path: str) -> LongestMatch:
    """Built once in each Python worker."""
    if path not in _AUTOMATA:
        _AUTOMATA[path] = LongestMatch(byte_vocabulary(path))
    return _AUTOMATA[path]


def wordpiece_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every whole text; the vocabulary is a path that all executors can read."""
    small_batches(docs.sparkSession)

    def count(batches):
        counter = WordCounter(_automaton(vocabulary))
        for batch in batches:
            rows = [counter.count(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_words long, n_tokens long, n_unknown long")
