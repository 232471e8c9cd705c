"""Token ids in seekable binary files.

A file is a run of independent zstandard frames, each holding the little-endian unsigned 32-bit ids of some whole
documents; then a skippable frame with the document index (a zstandard frame of ids, lengths and frame numbers); then the
seek table of the public "zstd seekable" layout, with the low 32 bits of each frame's XXH64 as checksum. A reader fetches
the tail, looks a document up, and decompresses that document's frame alone.

Null texts are empty texts and get the end id only; rows with the same doc_id keep one entry each, ordered by text; a
null doc_id sorts first; an empty table writes no file. Other columns are not read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoweave.llm.common import fresh_path, small_batches

FRAME_BYTES = 1 << 18
#: Characters of texts that are encoded together.
GROUP_BYTES = 1 << 21
#: White space to Python, not to the tokenizer.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Classes of bytes: odd ones keep the stretch around them whole, and so does a lead byte without a Latin-1 letter.
_BLANK, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[[9, 10, 11, 12, 13, 32]] = _BLANK
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _KIND[0xC3] = _LETTER
_KIND[0x27] = _ODD
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 0x20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SYMBOLS = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(29))
#: Fixed values of the public seekable layout.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC, CHECKSUM_FLAG = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80


class WordEncoder:
    """Encodes whole texts with a word-level tokenizers file that lower-cases and drops white space.

    Such a tokenizer never looks across white space, and what it looks at between two blanks are runs of letters, single digits
    and runs of other marks. Texts are cut into those by their bytes, many texts at once; each distinct one is encoded once by
    the library, and its ids are kept in arrays by a 64-bit hash and a check of its first bytes and length. Stretches between
    blanks with apostrophes, controls or letters beyond Latin-1 are kept whole. As in the library, the string of an added token
    in a text is that token, and what lies between two of them is a text of its own.
    """

    def __init__(self, path: str, most: int = 2_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("added tokens with conditions are not supported")
        self.added = {t.content: np.array([i], "<u4").tobytes() for i, t in added.items()}
        self.is_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=lambda t: (-len(t), t))) + ")") if self.added else re.compile(r"(?!)")
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.hashes, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _together(self, pieces: list[str]) -> list[np.ndarray]:
        """The ids of pieces that are one word each to the library."""
        out: list[np.ndarray] = []
        for at in range(0, len(pieces), 2000):
            part = pieces[at : at + 2000]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, word = np.asarray(got.ids, np.uint32), np.asarray(got.word_ids)
            if len(ids) == 0 or word[-1] != len(part) - 1:  # a piece that normalizes on again: one by one
                out += [self._whole(p) for p in part]
            else:
                cuts = np.searchsorted(word, np.arange(len(part) + 1)).tolist()
                out += [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def _learn(self, units: list[str]) -> list[np.ndarray]:
        """The ids of pieces, and of stretches that were kept whole."""
        simple, split, out = [], {}, {}
        for unit in units:
            if unit.isalpha() or len(unit) == 1:
                simple.append(unit)
            elif SEPARATORS.search(unit) or max(unit) > "\u024f":
                out[unit] = self._whole(unit)  # no second opinion on the library's classes
            else:
                split[unit] = self.pattern.findall(unit.lower())
        simple += sorted({p for parts in split.values() for p in parts} - {*simple})
        out |= dict(zip(simple, self._together(simple)))
        for unit, parts in split.items():
            out[unit] = np.concatenate([out[p] for p in parts]) if parts else np.zeros(0, np.uint32)
        return [out[unit] for unit in units]

    def _units(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, begin, end) of all units, lower-cased."""
        data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        kind = _KIND[data]
        after_lead = np.concatenate([[False], data[:-1] == 0xC3])
        second = after_lead & (data >= 0x80) & (data < 0xC0) & (data != 0x97) & (data != 0xB7)
        kind[second] = _LETTER
        kind[:-1][(data[:-1] == 0xC3) & ~second[1:]] = _ODD
        low = _LOW[data]
        low[second & (data <= 0x9E)] += 0x20
        blank = kind == _BLANK
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        starts, ends = edges[::2] + 1, edges[1::2] + 1
        odd = np.unique(np.searchsorted(starts, np.flatnonzero(kind == _ODD), "right") - 1)
        if len(odd):
            change = np.zeros(len(data) + 1, np.int8)
            change[starts[odd]] = 1
            change[ends[odd]] -= 1
            whole = np.cumsum(change[:-1], dtype=np.int8) > 0
            kind[whole] = _ODD
            low[whole] = data[whole]
        opens = np.ones(len(data), bool)
        opens[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        begin = np.flatnonzero(opens)
        keep = kind[begin] != _BLANK
        end = np.append(begin[1:], len(data))
        return low, begin[keep], end[keep]

    def _find(self, low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in self.ids the ids of each unit begin, and how many they are."""
        size = end - begin
        first = np.concatenate([[0], np.cumsum(size)])
        places = np.arange(first[-1]) - np.repeat(first[:-1] - begin, size)
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(size.max()), _MULTIPLIER, np.uint64)]))
        hashes = np.add.reduceat(_SYMBOLS[low[places]] * powers[places - np.repeat(begin, size)], first[:-1])
        hashes = (hashes ^ (hashes >> np.uint64(31))) * _MULTIPLIER
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        padded = np.concatenate([low, np.zeros(8, np.uint8)])
        b, n = begin[where], size[where]
        head = np.stack([np.where(n > k, padded[b + k], 0).astype(np.uint64) << np.uint64(8 * k) for k in range(6)]).sum(axis=0, dtype=np.uint64)
        checks = head | (np.minimum(n, 65_535).astype(np.uint64) << np.uint64(48))
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(0, len(self.hashes) - 1))
        known = (self.hashes[at] == distinct) & (self.checks[at] == checks) if len(self.hashes) else np.zeros(len(distinct), bool)
        out_begin, out_size = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        out_begin[known], out_size[known] = self.begin[at[known]], self.size[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = low.tobytes()
            got = self._learn([raw[x:y].decode("utf-8", "surrogatepass") for x, y in zip(b[new].tolist(), (b + n)[new].tolist())])
            sizes = np.array([len(g) for g in got])
            out_size[new], out_begin[new] = sizes, len(self.ids) + np.cumsum(sizes) - sizes
            self.ids = np.concatenate([self.ids, *got])
            hashes, checks = np.concatenate([self.hashes, distinct[new]]), np.concatenate([self.checks, checks[new]])
            begins, sizes = np.concatenate([self.begin, out_begin[new]]), np.concatenate([self.size, out_size[new]])
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.checks, self.begin, self.size = hashes[order], checks[order], begins[order], sizes[order]
        return out_begin[inverse], out_size[inverse]

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.hashes) > self.most:
            self.forget()
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        low, begin, end = self._units(raw)
        if not len(begin):
            yield from (b"" for _ in texts)
            return
        at, size = self._find(low, begin, end)
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(before[-1]) + np.repeat(at - before[:-1], size)].astype("<u4", copy=False)
        of = np.searchsorted(begin, np.cumsum([0] + [len(t) + 1 for t in raw]) + 1)
        cuts = before[of]
        for a, b in zip(cuts, cuts[1:]):
            yield ids[a:b].tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        group, held = [], 0
        for text in [*texts, None]:
            if text is None or held >= GROUP_BYTES or self.is_added.search(text):
                if group:
                    yield from self._group(group)
                group, held = [], 0
            if text is None:
                continue
            if self.is_added.search(text):
                yield b"".join([self.added.get(part) or next(self._group([part])) for part in self.is_added.split(text)])
            else:
                group.append(text)
                held += len(text)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """One for each Python worker: its caches serve all tasks that the worker runs."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class FrameWriter:
    """Writes one file, frame by frame."""

    def __init__(self, stream):
        self.stream, self.table, self.docs = stream, [], []
        self.buffer: list[bytes] = []
        self.held = 0
        self.compressor = zstandard.ZstdCompressor(level=3)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.held + len(ids) > FRAME_BYTES:
            self.flush()
        self.docs.append((0 if doc_id is None else doc_id, doc_id is None, len(ids) // 4, len(self.table)))
        self.buffer.append(ids)
        self.held += len(ids)

    def flush(self) -> None:
        raw = b"".join(self.buffer)
        packed = self.compressor.compress(raw)
        self.stream.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.buffer, self.held = [], 0

    def close(self) -> None:
        if self.buffer:
            self.flush()
        index = np.array(self.docs, dtype=[("doc", "<i8"), ("null", "u1"), ("n", "<u4"), ("frame", "<u4")]).tobytes()
        packed = self.compressor.compress(index)
        self.stream.write(struct.pack("<II", SKIPPABLE_INDEX, len(packed) + 4) + packed + struct.pack("<I", len(packed)))
        entries = b"".join(struct.pack("<III", *t) for t in self.table)
        self.stream.write(struct.pack("<II", SKIPPABLE_SEEK, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEK_MAGIC))


class FrameReader:
    """Reads documents of one file, decompressing only the frames that hold them."""

    def __init__(self, stream, length: int):
        self.stream = stream
        stream.seek(length - 9)
        frames, flags, magic = struct.unpack("<IBI", stream.read(9))
        if magic != SEEK_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table at the end")
        seek = length - 9 - 12 * frames - 8
        stream.seek(seek)
        raw = stream.read(8 + 12 * frames)
        self.table = np.frombuffer(raw[8:], dtype="<u4").reshape(frames, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        stream.seek(seek - 4)
        (packed,) = struct.unpack("<I", stream.read(4))
        stream.seek(seek - 4 - packed)
        index = zstandard.ZstdDecompressor().decompress(stream.read(packed))
        self.docs = np.frombuffer(index, dtype=[("doc", "<i8"), ("null", "u1"), ("n", "<u4"), ("frame", "<u4")])

    def frame(self, k: int) -> bytes:
        self.stream.seek(int(self.offsets[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.stream.read(int(self.table[k, 0])), max_output_size=int(self.table[k, 1]) or 1)
        if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def all(self) -> Iterator[tuple[int | None, bytes]]:
        last, raw, at = -1, b"", 0
        for doc, null, n, frame in self.docs.tolist():
            if frame != last:
                last, raw, at = frame, self.frame(frame), 0
            yield None if null else doc, raw[at : at + 4 * n]
            at += 4 * n

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of each entry of a document; only their frames are read."""
        found = []
        for row in np.flatnonzero((self.docs["doc"] == doc_id) & (self.docs["null"] == 0)):
            frame = self.docs["frame"][row]
            same = np.flatnonzero(self.docs["frame"] == frame)
            at = 4 * int(self.docs["n"][same[same < row]].sum())
            found.append(np.frombuffer(self.frame(int(frame))[at : at + 4 * int(self.docs["n"][row])], "<u4"))
        return found


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> list[tuple]:
    """Encode and write `doc_id`, `text` in ascending doc_id order, one file for each range of ids.

    Returns the manifest, a row for each file in that order: file name, documents, tokens. A file appears by a rename, under a
    name of the task's attempt: of a task that ran twice only the attempt that Spark took is in the manifest.
    """
    small_batches(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def write(batches):
        place, root = fs.FileSystem.from_uri(folder)
        encoder, out, name, n_docs, n_tokens, first = None, None, uuid.uuid4().hex, 0, 0, None
        for batch in batches:
            if batch.num_rows and out is None:
                encoder = encoder_of(tokenizer)
                place.create_dir(root, recursive=True)
                out = place.open_output_stream(f"{root}/{name}.tmp")
                writer = FrameWriter(out)
            ids = batch.column(0).to_pylist()
            if first is None and ids:
                first = (ids[0],)
            for doc_id, encoded in zip(ids, encoder.encode([t or "" for t in batch.column(1).to_pylist()]) if ids else ()):
                writer.add(doc_id, encoded + end)
                n_docs, n_tokens = n_docs + 1, n_tokens + len(encoded) // 4 + 1
        if out is not None:
            writer.close()
            out.close()
            place.move(f"{root}/{name}.tmp", f"{root}/{name}.ids.zst")
            yield pa.RecordBatch.from_pydict({"file": [f"{name}.ids.zst"], "first": pa.array([first[0]], pa.int64()), "n_docs": [n_docs], "n_tokens": [n_tokens]})

    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = ranged.mapInArrow(write, "file string, first long, n_docs long, n_tokens long").collect()
    return [(r.file, r.n_docs, r.n_tokens) for r in sorted(rows, key=lambda r: (r.first is not None, r.first or 0))]


def read_token_files(spark: SparkSession, folder: str, manifest: list[tuple]) -> DataFrame:
    """All documents of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""
    starts, start = [], 0
    for name, _, n in manifest:
        starts.append((name, start))
        start += n
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not starts:
        return spark.createDataFrame([], schema)

    def read(batches):
        place, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = f"{root}/{name}"
                rows = []
                with place.open_input_file(path) as stream:
                    for doc_id, raw in FrameReader(stream, stream.size()).all():
                        rows.append((doc_id, at, len(raw) // 4, zlib.crc32(raw)))
                        at += len(raw) // 4
                        if len(rows) >= 20_000:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    files = spark.createDataFrame(starts, "file string, start long").repartition(len(starts))
    return files.mapInArrow(read, schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the files to the shared folder, read them back, and return what was read."""
    folder = fresh_path(docs.sparkSession, "token-files")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read_token_files(docs.sparkSession, folder, write_token_files(docs, folder, tokenizer, end_id))
