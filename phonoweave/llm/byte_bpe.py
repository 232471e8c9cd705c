"""Byte-level BPE with vectorised pre-tokenisation.

Code points map to classes by one array lookup. The public GPT-2 pattern over those classes is a finite transducer of eight
states; the transition function of each text block is composed state by state over all blocks at once, blocks are joined by
an associative scan, and a second pass reads off where pieces start. No regular expression runs. Slices at those starts feed
a cached pair merging; piece offsets are kept, and decoding goes from the ids through the token table.

Null and empty texts have no ids. Repeated rows are rows of their own. The caches are bounded; texts are never cut.
An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonoweave.llm.common import small_batches

# Classes of code points, and of positions after looking at what follows.
LETTER, NUMBER, OTHER, SHORT, LONG, JOINING, SINGLE, RUN, BREAK = range(9)
# States: what kind of piece the last character belongs to; a leading blank; letters of a contraction still to come; none.
IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_BLANKS, AFTER_BLANK, ONE_LEFT, TWO_LEFT, FREE = range(8)
#: The white space of the pattern's \s: a fixed value of Unicode.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BLOCK = 128


def _classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for point in range(sys.maxunicode + 1):
        major = unicodedata.category(chr(point))[0]
        if major == "L":
            table[point] = LETTER
        elif major == "N":
            table[point] = NUMBER
    table[WHITE_SPACE] = RUN
    return table


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a piece starts, by symbol and state."""
    step, starts = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for symbol, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHER), (SHORT, IN_OTHER), (LONG, IN_OTHER)):
        step[symbol] = {SHORT: ONE_LEFT, LONG: TWO_LEFT}.get(symbol, state)
        step[symbol, [state, AFTER_BLANK]] = state
        starts[symbol, [state, AFTER_BLANK]] = False
    step[LETTER, TWO_LEFT], step[LETTER, ONE_LEFT] = ONE_LEFT, FREE
    starts[LETTER, [TWO_LEFT, ONE_LEFT]] = False
    step[JOINING], step[SINGLE], step[RUN], step[BREAK] = AFTER_BLANK, IN_BLANKS, IN_BLANKS, FREE
    starts[RUN, IN_BLANKS] = False
    return step, starts


class PreTokenizer:
    def __init__(self):
        self.classes = _classes()
        self.step, self.starts = _machine()

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """points: code points of texts, each followed by a 0xFFFFFFFF."""
        gap = points == 0xFFFFFFFF
        symbol = self.classes[np.where(gap, 0, points)]
        symbol[gap] = BREAK
        after = np.append(symbol[1:], BREAK)
        white = symbol == RUN
        last = white & (after != RUN) & (after != BREAK)
        symbol[last] = np.where(points[last] == 0x20, JOINING, SINGLE)
        quote = np.flatnonzero(points == 0x27)
        if len(quote):
            ahead = np.append(points, [0xFFFFFFFF] * 2)
            one, two = ahead[quote + 1], ahead[quote + 2]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = np.zeros(len(quote), bool)
            for a, b in ("re", "ve", "ll"):
                long |= (one == ord(a)) & (two == ord(b))
            symbol[quote[short]] = SHORT
            symbol[quote[long]] = LONG
        return symbol

    def boundaries(self, points: np.ndarray) -> np.ndarray:
        """Whether a piece (or a break) starts at each position."""
        symbol = self.symbols(points)
        n = len(symbol)
        lanes = -(-n // BLOCK)
        grid = np.full(lanes * BLOCK, BREAK, np.uint8)
        grid[:n] = symbol
        grid = np.ascontiguousarray(grid.reshape(lanes, BLOCK).T)
        flat = self.step.ravel()
        # Compose each block's transition function, all blocks at once.
        function = np.tile(np.arange(8, dtype=np.uint8), (lanes, 1))
        for row in grid:
            function = flat[(row.astype(np.int16) * 8)[:, None] + function]
        # Scan: function[k] becomes the composition of blocks 0..k.
        reach = 1
        while reach < lanes:
            function[reach:] = np.take_along_axis(function[reach:], function[:-reach].astype(np.intp), axis=1)
            reach *= 2
        state = np.empty(lanes, np.uint8)
        state[0], state[1:] = FREE, function[:-1, FREE]
        found = np.empty((BLOCK, lanes), bool)
        first = self.starts.ravel()
        for k, row in enumerate(grid):
            at = row.astype(np.int16) * 8 + state
            found[k] = first[at]
            state = flat[at]
        return found.T.ravel()[:n]

    def pieces(self, texts: list[str]) -> list[tuple[str, np.ndarray]]:
        """Each text with the offsets of its pieces, in code points, and its length at the end."""
        joined = "\x00".join(texts) + "\x00"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        points[ends] = 0xFFFFFFFF
        starts = np.flatnonzero(self.boundaries(points))
        cut = np.searchsorted(starts, ends, side="left")
        begin = 0
        out = []
        for text, end, k, before in zip(texts, ends, cut, np.concatenate([[0], cut[:-1] + 1])):
            out.append((text, np.append(starts[before:k], end) - begin))
            begin = end + 1
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ByteBpe:
    """Pair merging by ranks, lowest first and leftmost among equals, with a bounded cache of pieces."""

    def __init__(self, ranks: dict[bytes, int], most: int = 300_000):
        self.ranks, self.most = ranks, most
        self.tokens = {v: k for k, v in ranks.items()}
        self.split = PreTokenizer()
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        if len(piece) > 100:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        while pairs:
            least = min(pairs)
            if least == 1 << 60:
                break
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap, in n log n steps."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            end[i], alive[j], after[i] = stop, False, after[j]
            if after[j] < n:
                before[after[j]] = i
                k = end[after[j]]
                if (r := ranks.get(piece[i:k])) is not None:
                    heapq.heappush(heap, (r, i, k))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])

    def encode(self, texts: list[str]) -> list[tuple[list[tuple[int, ...]], np.ndarray]]:
        """For each text the ids of each piece, and the pieces' offsets."""
        out, cache = [], self.cache
        for text, offsets in self.split.pieces(texts):
            at = offsets.tolist()
            pieces = [text[a:b] for a, b in zip(at, at[1:])]
            if len(cache) > self.most:  # the first seen are the most frequent
                cache = self.cache = dict(itertools.islice(cache.items(), self.most // 2))
            ids = []
            for p in pieces:
                got = cache.get(p)
                if got is None:
                    got = self.merge(p.encode("utf-8", "surrogatepass"))
                    if len(p) <= 64:
                        cache[p] = got
                ids.append(got)
            out.append((ids, offsets))
        return out

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


_CODERS: dict[str, ByteBpe] = {}


def coder(path: str) -> ByteBpe:
    """Built once in each Python worker."""
    if path not in _CODERS:
        _CODERS[path] = ByteBpe(read_ranks(path))
    return _CODERS[path]


#: Characters of the texts that are encoded at a time.
CHUNK_CHARS = 1 << 19


def _chunks(texts: list[str]):
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= CHUNK_CHARS:
            yield part
            part, held = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, ids (all of them), offsets (code point offsets of the pieces, then the text's length)."""
    small_batches(docs.sparkSession)

    def run(batches):
        bpe = coder(ranks)
        for batch in batches:
            ids, offsets = [], []
            for part in _chunks([t or "" for t in batch.column(1).to_pylist()]):
                for pieces, at in bpe.encode(part):
                    ids.append([i for p in pieces for i in p])
                    offsets.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int32()))], names=["doc_id", "ids", "offsets"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, offsets array<int>")


def round_trip(docs: DataFrame, ranks: str, keep_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256, n_pieces, and the ids if asked for."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_pieces", *["ids"] * keep_ids]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()))

    def run(batches):
        bpe = coder(ranks)
        decimal = [str(i) for i in range(max(bpe.tokens, default=0) + 1)]
        for batch in batches:
            rows = []
            for part in _chunks([t or "" for t in batch.column(1).to_pylist()]):
                for pieces, offsets in bpe.encode(part):
                    ids = [i for p in pieces for i in p]
                    shown = ",".join([decimal[i] for i in ids])
                    rows.append((len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest(), len(offsets) - 1, *[ids] * keep_ids))
            columns = list(zip(*rows)) if rows else [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_pieces long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
