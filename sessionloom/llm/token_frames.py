"""Operator 3: token ids in files of independent zstandard frames with a trailing seek table.

File layout (all integers little-endian), the public zstandard seekable format with a document list:

    frame 0 .. frame n-1     one zstandard frame for each document: its ids as unsigned 32-bit integers
    skippable frame 0x184D2A50   n signed 64-bit document ids, then ceil(n / 8) bytes of null flags
    skippable frame 0x184D2A5E   n entries of (compressed size, plain size, checksum), 3 x 32 bits,
                                 then the footer: n (32 bits), descriptor 0x80, magic 0x8F92EAB1

The checksum is the low 32 bits of the xxh64 of a frame's plain bytes. A reader fetches the footer,
then the table, then only the frames of the documents it wants.

Texts are encoded and compressed before the shuffle, so it moves frames and not texts. Documents are
dealt to files by ranges of doc_id and sorted within a file, so the files in name order hold all ids in
ascending doc_id order. Files are written under a hidden name and renamed to one of the task attempt's own,
which the manifest of the finished attempts lists: what a lost executor's task left is never read. Frames
hold less than 4 GiB, the format's bound: a text of 2^30 tokens raises an error when it is written.

Defined results: a null text counts as empty (its document holds the end id alone); a null doc_id sorts
first; rows that share a doc_id are ordered by their encoded frame, so reruns agree; an empty table
writes no file; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm._shared import file_system, hold, new_folder, parts_of, written
from sessionloom.llm._words import Kept, gathered, table_of

SEEK_MAGIC, DOCS_MAGIC, FOOTER_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
#: Bytes of distinct units kept by a Python worker.
KEPT_BYTES = 64 << 20
#: Characters of text that a worker encodes at once.
PART_CHARS = 2_000_000
#: A unit that is one chunk: ASCII letters, or one space before visible characters of any kind.
_PLAIN = re.compile(r" ?(?:[A-Za-z]+|[^\W\d_]+|[^\w\s]+)\Z")


class Encoder:
    """The tokenizers library over distinct units, kept for one Python task.

    The byte-level pre-tokenizer always cuts between a visible character and ASCII white space, and between
    an ASCII letter and an ASCII character that is none, so what stands between such places can be encoded
    apart. Texts with other white space are encoded by chunks that the same rule allows; texts with the
    four characters that Python and the library class differently, or with an added token's content, are encoded whole.
    """

    _chunks = re.compile(r"\s+(?!\S)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?![^\W\d_])| ?\S+|\s").findall
    _odd = re.compile("[\x1c-\x1f]").search
    _wide = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
    _space, _letter = table_of(lambda c: c in " \t\n\r\x0b\x0c"), table_of(str.isalpha)
    _cuts = [(~_space, _space), (_letter, table_of(lambda c: not c.isalpha() and c not in " \t\n\r\x0b\x0c"))]

    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # Compared without regard to case, which a normalizer may change.
        self._added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE).search if added else None
        # A part of each added token that has no case, looked for first.
        self._hints = [max(re.findall(r"[^A-Za-z]+|$", a), key=len) if a.isascii() else "" for a in added]
        self.kept = Kept(kept_bytes)
        feed = self.library.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _visible(self, chunks: list[str]) -> list[bytes]:
        """Chunks without line feeds, encoded as the lines of one text: a line feed before a visible character,
        or before one space and a visible character, is always a token of its own."""
        if self.feed is None:
            return self._raw(chunks)
        out: list[bytes] = []
        for k in range(0, len(chunks), 20_000):
            some = chunks[k : k + 20_000]
            ids = np.array(self.library.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = 4 * np.r_[np.flatnonzero(ids == self.feed), len(ids)]
            raw, starts = ids.tobytes(), np.r_[0, ends[:-1] + 4]
            out += [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return out

    def _has_added(self, text: str) -> bool:
        return any(h in text for h in self._hints) and self._added(text) is not None

    def _is_whole(self, text: str) -> bool:
        return not text.isascii() and self._wide(text) is not None or self._odd(text) is not None or self._has_added(text)

    def _encode_new(self, units: list[bytes]) -> list[bytes]:
        """Ids of units: whole if odd, else by their distinct chunks."""
        texts = [u.decode() for u in units]
        whole = {k for k, t in enumerate(texts) if self._is_whole(t)} if self._is_whole("\n".join(texts)) else set()
        raw = {k for k in whole if self._odd(texts[k]) or self._has_added(texts[k])}
        plain = _PLAIN.match
        cut = {k: self._chunks(t) for k, t in enumerate(texts) if k not in raw and (k in whole or not plain(t))}
        every = {c for cs in cut.values() for c in cs}
        every.update(t for k, t in enumerate(texts) if k not in cut and k not in raw)
        blank = [c for c in every if c.isspace()]
        shown = list(every.difference(blank))
        ids = dict(zip(blank, self._raw(blank), strict=True))
        ids.update(zip(shown, self._visible(shown), strict=True))
        return [self._raw([t])[0] if k in raw else b"".join([ids[c] for c in cut[k]]) if k in cut else ids[t] for k, t in enumerate(texts)]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, where each row's begin and end); a null counts as empty."""
        whole = np.fromiter((bool(t) and self._is_whole(t) for t in texts.to_pylist()), bool, len(texts))
        return gathered(texts, self._cuts, whole, self.kept, self._encode_new)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        flat, at = self.encode_column(pa.array(texts, pa.large_string()))
        return [flat[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file; it goes once another operator keeps something."""
    hold(f"tokenizer {path}", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def seek_table(entries: list[tuple[int, int, int]]) -> bytes:
    body = np.array(entries, "<u4").reshape(-1, 3).tobytes() + struct.pack("<IBI", len(entries), 0x80, FOOTER_MAGIC)
    return struct.pack("<II", SEEK_MAGIC, len(body)) + body


def doc_list(ids: list[int | None]) -> bytes:
    body = np.array([i or 0 for i in ids], "<i8").tobytes() + np.packbits([i is None for i in ids], bitorder="little").tobytes()
    return struct.pack("<II", DOCS_MAGIC, len(body)) + body


class Reader:
    """Random access to one file; opens a path or URI that pyarrow's file systems know."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != FOOTER_MAGIC or flags != 0x80:
            raise ValueError(f"{uri} has no seek table with checksums")
        body = self.file.read_at(12 * n, size - 9 - 12 * n)
        self.table = np.frombuffer(body, "<u4").reshape(n, 3)
        self.at = np.r_[0, np.cumsum(self.table[:, 0].astype(np.int64))]
        docs = self.file.read_at(8 * n + (n + 7) // 8, int(self.at[-1]) + 8)
        self.nulls = np.unpackbits(np.frombuffer(docs[8 * n :], np.uint8), bitorder="little")[:n].astype(bool)
        self.doc_ids = np.frombuffer(docs[: 8 * n], "<i8")
        self.unpack = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.table)

    def ranges(self, most_bytes: int = 8 << 20) -> list[tuple[int, int]]:
        """Ranges of documents of at most most_bytes each in the file (one document at least)."""
        out, k = [], 0
        while k < len(self):
            to = max(k + 1, int(np.searchsorted(self.at, self.at[k] + most_bytes, "right")) - 1)
            out.append((k, to))
            k = to
        return out

    def frames(self, k: int, to: int) -> Iterator[bytes]:
        """The plain bytes of documents k to to - 1, from one read."""
        low = int(self.at[k])
        raw = self.file.read_at(int(self.at[to]) - low, low)
        for j in range(k, to):
            yield self._plain(j, raw[int(self.at[j]) - low : int(self.at[j + 1]) - low])

    def frame(self, k: int) -> bytes:
        """The plain bytes of document k of this file, checked."""
        return self._plain(k, self.file.read_at(int(self.table[k, 0]), int(self.at[k])))

    def _plain(self, k: int, packed: bytes) -> bytes:
        plain, check = (int(x) for x in self.table[k, 1:])
        out = self.unpack.decompress(packed, max_output_size=plain) if plain else b""
        if len(out) != plain or xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return out

    def find(self, doc_id: int) -> list[int]:
        """Frames of a document, by binary search (ids ascend; nulls come first)."""
        skip = int(self.nulls.sum())
        lo, hi = (np.searchsorted(self.doc_ids[skip:], doc_id, side) + skip for side in ("left", "right"))
        return list(range(int(lo), int(hi)))

    def close(self) -> None:
        self.file.close()


def frames(docs: DataFrame, tokenizer_path: str, end_id: int, level: int = 3) -> DataFrame:
    """doc_id, n_tokens, check, frame for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, pack = np.array([end_id], "<u4").tobytes(), zstandard.ZstdCompressor(level=level)
        e = encoder(tokenizer_path)
        for whole in batches:
            for a, b in parts_of(whole.column(1), PART_CHARS):
                batch = whole.slice(a, b - a)
                flat, at = e.encode_column(batch.column(1))
                plain = [flat[i:j].tobytes() + end for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).cast(pa.int64()),
                        pa.array(np.diff(at) + 1, pa.int64()),
                        pa.array([xxhash.xxh64_intdigest(p) & 0xFFFFFFFF for p in plain], pa.int64()),
                        pa.array([pack.compress(p) for p in plain], pa.binary()),
                    ],
                    ["doc_id", "n_tokens", "check", "frame"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, check long, frame binary")


def _borders(docs: DataFrame, files: int) -> np.ndarray:
    """The least doc_id of every file but the first: ranges of about equal numbers of rows, from this one column."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").repartitionByRange(files, "doc_id")

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [pc.min(b.column(0)).as_py() for b in batches if b.num_rows]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([min(found)], pa.int64())], ["doc_id"])

    return np.sort(np.array([r[0] for r in ids.mapInArrow(least, "doc_id long").collect()], np.int64))[1:]  # one row a file


def write_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, docs_per_file: int = 20_000) -> DataFrame:
    """Writes the files; returns the manifest (file, file_no, n_docs, n_tokens, low, high), one row a file.

    File borders are ranges of doc_id alone, so finding them moves one column; rows that share a doc_id
    are in one file. low and high are a file's least and greatest doc_id (null without any).
    """
    spark = docs.sparkSession
    files = max(1, -(-docs.count() // docs_per_file))
    cuts = spark.sparkContext.broadcast(_borders(docs, files) if files > 1 else np.zeros(0, np.int64))
    files = len(cuts.value) + 1

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            at = np.searchsorted(cuts.value, ids.fill_null(0).to_numpy(zero_copy_only=False), "right")
            at[np.asarray(ids.is_null())] = 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], [*b.schema.names, "file_no"])

    made = frames(docs, tokenizer_path, end_id).mapInArrow(numbered, "doc_id long, n_tokens long, check long, frame binary, file_no int")
    dealt = made.repartitionById(files, "file_no").sortWithinPartitions("file_no", F.col("doc_id").asc_nulls_first(), "frame")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        out = no = None
        entries: list[tuple[int, int, int]] = []
        ids: list[int | None] = []

        def close() -> pa.RecordBatch:
            out.write(doc_list(ids) + seek_table(entries))
            out.close()
            name = f"part-{no:09d}-{attempt}.zst"
            fs.move(f"{base}/.{name}", f"{base}/{name}")
            known = [i for i in ids if i is not None]
            row = (f"{folder}/{name}", no, len(ids), sum(e[1] for e in entries) // 4, known[0] if known else None, known[-1] if known else None)
            kinds = (pa.string(), *[pa.int64()] * 5)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["file", "file_no", "n_docs", "n_tokens", "low", "high"])

        for b in batches:
            for doc, tokens, check, frame, at in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if at != no:
                    if out is not None:
                        yield close()
                    no, entries, ids = at, [], []
                    out = fs.open_output_stream(f"{base}/.part-{no:09d}-{attempt}.zst", compression=None)
                if 4 * tokens >= 1 << 32:
                    raise ValueError(f"document {doc} has {tokens} tokens; a frame holds fewer than 2^30")
                out.write(frame)
                entries.append((len(frame), 4 * tokens, check))
                ids.append(doc)
        if out is not None:
            yield close()

    return written(dealt.mapInArrow(write, "file string, file_no long, n_docs long, n_tokens long, low long, high long"), "manifest")


def read_back(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of a manifest.

    The manifest has one row a file; a file's start is the sum of the tokens of the files before it.
    """
    from pyspark.sql import Window as W

    placed = manifest.select(
        "file", F.coalesce(F.sum("n_tokens").over(W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("file_start")
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, start in zip(b["file"], b["file_start"], strict=True):
                r = Reader(file)
                sizes = r.table[:, 1].astype(np.int64) // 4
                starts = start + np.r_[0, np.cumsum(sizes)]
                for k, to in r.ranges():
                    yield pd.DataFrame({
                        "doc_id": pd.array(np.where(r.nulls[k:to], pd.NA, r.doc_ids[k:to]), "Int64"),
                        "start": starts[k:to],
                        "n_tokens": sizes[k:to],
                        "ids_crc32": [zlib.crc32(x) for x in r.frames(k, to)],
                    })
                r.close()

    spread = placed.repartition(max(1, min(10_000, manifest.count())), "file")
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(spark: SparkSession, manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the wanted doc_ids (a bounded request list), opening only files that may hold
    them and decompressing their frames only."""
    asked = np.array(sorted({r[0] for r in wanted.select("doc_id").where("doc_id IS NOT NULL").collect()}), np.int64)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, low, high in zip(b["file"], b["low"], b["high"], strict=True):
                some = asked[(asked >= low) & (asked <= high)] if pd.notna(low) else asked[:0]
                if len(some):
                    r = Reader(file)
                    for doc in some.tolist():
                        for k in r.find(doc):
                            yield pd.DataFrame({"doc_id": [doc], "ids": [np.frombuffer(r.frame(k), "<u4").astype(np.int64)]})
                    r.close()

    return manifest.select("file", "low", "high").mapInPandas(read, "doc_id long, ids array<long>")


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int = 2, docs_per_file: int = 20_000, folder: str | None = None) -> DataFrame:
    folder = folder or new_folder(docs.sparkSession, "token-frames")
    if "://" not in folder:
        folder = f"file://{folder.removeprefix('file:')}"
    return read_back(write_files(docs, folder, tokenizer_path, end_id, docs_per_file))
