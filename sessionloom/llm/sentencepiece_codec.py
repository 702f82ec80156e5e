"""Operator 1: SentencePiece BPE encoding and decoding.

Encoding runs vectorised merge rounds over flat symbol arrays. No piece of the vocabulary has the
space mark behind another character, so merges never cross the start of a marked run: a text is cut
there into words, and each distinct word is encoded once and kept. In a round every unfinished word
finds its best pair rank by a segmented minimum; the leftmost non-overlapping pairs of that rank are
merged at once, the arrays are compacted, and rounds go on until no pair remains.

Merging several pairs of a word at once equals the library's one-at-a-time queue only if no merge
creates a pair at least as good as the one being merged. Each round checks this; the rare words that
break it (runs of spaces, for example) are finished by an exact queue instead.

Defined results: a null text counts as empty and gives the end id alone; other columns pass through
untouched; repeated rows are encoded independently; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sessionloom.llm._shared import hold, numbered, parts_of
from sessionloom.llm._words import Kept, gathered, table_of

MARK = "▁"
#: Distinct units kept by a Python worker, and their bytes.
KEPT_WORDS = 2_000_000
KEPT_BYTES = 64 << 20
#: Characters of text that a worker encodes at once.
PART_CHARS = 2_000_000
_NO_RANK = np.int64(1 << 40)
_SPACE, _LETTER = table_of(" ".__eq__), table_of(str.isalpha)
_OTHER = table_of(lambda c: not c.isalpha() and c != " ")


class Codec:
    """Encoder and decoder over one model file whose normaliser is the identity with a leading space mark."""

    def __init__(self, path: str, kept_words: int = KEPT_WORDS, kept_bytes: int = KEPT_BYTES):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(n)]
        usable = [i for i in range(n) if not (self.library.is_control(i) or self.library.is_byte(i) or self.library.is_unknown(i) or self.library.is_unused(i))]
        if any(MARK in self.pieces[i].lstrip(MARK) for i in usable):
            raise ValueError("a piece crosses the start of a word; this vocabulary can't be cut into words")
        self.id_of = {self.pieces[i]: i for i in usable}
        self.byte_id = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end_id = self.library.eos_id()
        # Better scores get smaller ranks; equal scores share a rank.
        scores = np.array([self.library.get_score(i) for i in usable])
        self.rank_of = dict(zip(usable, np.unique(-scores, return_inverse=True)[1].tolist(), strict=True))
        self._pair_table()
        # Words end before a marked run; also around line feeds, and where letters meet other characters, if no
        # piece crosses such a place, for then no merge can.
        ways = (rf"\n+|{MARK}*(?:[^\W\d_]+|(?:[\d_]|[^\w{MARK}\n])+)|{MARK}+", rf"\n+|{MARK}*[^{MARK}\n]+|{MARK}+", rf"{MARK}*[^{MARK}]+|{MARK}+")
        found = [re.compile(way).findall for way in ways]
        best = next(k for k, f in enumerate(found) if all(f(self.pieces[i]) == [self.pieces[i]] for i in usable))
        self.words = found[best]
        # The same places in UTF-8, where ASCII bytes meet.
        self.cuts = [(~_SPACE, _SPACE), *([(_LETTER, _OTHER), (_OTHER, _LETTER)] if best == 0 else [])]
        self.kept = Kept(kept_bytes, kept_words)

    def _pair_table(self) -> None:
        """All (left id, right id) -> merged id, as sorted keys for binary search."""
        self.symbol_of = dict(self.id_of)
        keys, merged = [], []
        for piece, i in self.id_of.items():
            for k in range(1, len(piece)):
                a, b = self.id_of.get(piece[:k]), self.id_of.get(piece[k:])
                # A single character outside the vocabulary may still be half of a piece.
                if a is None and k == 1:
                    a = self._symbol(piece[:k])
                if b is None and k == len(piece) - 1:
                    b = self._symbol(piece[k:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    merged.append(i)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pair_keys = np.array(keys, np.int64)[order]
        self.pair_ids = np.array(merged, np.int64)[order]
        self.pair_ranks = np.array([self.rank_of[i] for i in self.pair_ids.tolist()], np.int64)

    def _symbol(self, char: str) -> int:
        """A symbol number for a character; those outside the vocabulary get numbers beyond it by code point."""
        return self.id_of.get(char, len(self.pieces) + ord(char))

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of pairs; _NO_RANK where there is no such piece."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_ranks[at], _NO_RANK), self.pair_ids[at]

    def _queue(self, symbols: list[int]) -> list[int]:
        """One merge at a time: the best rank, leftmost among equals."""
        n = len(symbols)
        symbols, left, right = list(symbols), list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0:
                key = (symbols[a] << 32) | symbols[b]
                at = int(np.searchsorted(self.pair_keys, key))
                if at < len(self.pair_keys) and self.pair_keys[at] == key:
                    heapq.heappush(heap, (int(self.pair_ranks[at]), a, b, symbols[a], symbols[b]))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, sa, sb = heapq.heappop(heap)
            if symbols[a] != sa or symbols[b] != sb or right[a] != b:
                continue
            key = (sa << 32) | sb
            symbols[a] = int(self.pair_ids[int(np.searchsorted(self.pair_keys, key))])
            symbols[b] = -1
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [s for s in symbols if s >= 0]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words as little-endian unsigned 32-bit integers, by merge rounds, then byte fallback."""
        if not words:
            return []
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        queued: dict[int, list[int]] = {}
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        uniq, back = np.unique(points, return_inverse=True)
        sym = np.array([self._symbol(chr(c)) for c in uniq.tolist()], np.int64)[back] if len(points) else points
        word = np.repeat(np.arange(len(words)), sizes)
        # rank[k] and merged[k] belong to the pair of symbols k and k + 1.
        rank, merged = self._pairs(sym, np.r_[sym[1:], 0])
        rank[np.r_[word[1:] != word[:-1], True]] = _NO_RANK

        while len(sym):
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, heads)
            span = np.diff(np.r_[heads, len(sym)])
            more = best < _NO_RANK
            if not more.all():
                going = np.repeat(more, span)
                ended.append((sym[~going], word[~going]))
                sym, word, rank, merged, best, span = sym[going], word[going], rank[going], merged[going], best[more], span[more]
                if not len(sym):
                    break
            best = np.repeat(best, span)
            # Leftmost non-overlapping: in each run of adjacent hits take every second from its start.
            take = np.flatnonzero(rank == best)
            run = np.r_[True, take[1:] - take[:-1] > 1]
            if not run.all():
                take = take[(take - np.maximum.accumulate(np.where(run, take, 0))) % 2 == 0]
            made, limit = merged[take], best[take]
            # Pairs that exist for a moment or from now on, next to each merge, in the queue's order.
            after, before = take + 2, take - 1
            inside = after < len(sym)
            inside[inside] = word[after[inside]] == word[take[inside]]
            chained = np.r_[False, take[1:] - take[:-1] == 2]
            has_left = before >= 0
            has_left[has_left] = word[before[has_left]] == word[take[has_left]]
            chained &= has_left
            right_rank, right_id = np.full(len(take), _NO_RANK), np.zeros(len(take), np.int64)
            right_rank[inside], right_id[inside] = self._pairs(made[inside], sym[after[inside]])
            left_sym = sym[np.maximum(before, 0)]
            left_sym[chained] = made[np.flatnonzero(chained) - 1]
            left_rank, left_id = np.full(len(take), _NO_RANK), np.zeros(len(take), np.int64)
            left_rank[has_left], left_id[has_left] = self._pairs(left_sym[has_left], made[has_left])
            bad = word[take[(right_rank <= limit) | (left_rank <= limit)]]
            # Only pairs next to a merge are looked up anew; of merges side by side the second knows their pair.
            sym[take], rank[take], merged[take] = made, right_rank, right_id
            at = np.where(chained, take - 2, before)[has_left]
            rank[at], merged[at] = left_rank[has_left], left_id[has_left]
            keep = np.ones(len(sym), bool)
            keep[take + 1] = False
            if len(bad):
                # Finish these words one merge at a time, from their characters.
                again = np.zeros(len(words), bool)
                again[bad] = True
                for k in np.flatnonzero(again).tolist():
                    queued[k] = self._queue([self._symbol(c) for c in words[k]])
                keep &= ~again[word]
            sym, word, rank, merged = sym[keep], word[keep], rank[keep], merged[keep]
        sym, word = (np.concatenate(x) for x in zip(*ended, strict=True)) if ended else (sym, word)
        order = np.argsort(word, kind="stable")
        ends = 4 * np.cumsum(np.bincount(word, minlength=len(words)))
        flat = sym[order].astype("<u4").tobytes()
        out = [flat[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
        # Characters outside the vocabulary become their bytes.
        n = len(self.pieces)
        for k, symbols in queued.items():
            out[k] = np.array(symbols, "<u4").tobytes()
        unknown = {*np.unique(word[sym >= n]).tolist(), *(k for k, symbols in queued.items() if max(symbols) >= n)}
        for k in unknown:
            ids = [i for s in np.frombuffer(out[k], "<u4").tolist() for i in ([s] if s < n else [self.byte_id[b] for b in chr(s - n).encode("utf-8", "surrogatepass")])]
            out[k] = np.array(ids, "<u4").tobytes()
        return out

    def _encode_new(self, units: list[bytes]) -> list[bytes]:
        """Ids of units; long ones and those with marks of their own are cut into words first."""
        marked = [u.decode().replace(" ", MARK) for u in units]
        long = [k for k, u in enumerate(marked) if len(u) > 40 or MARK in u[1:]]
        cut = {k: self.words(marked[k]) for k in long}
        words = list({w for ws in cut.values() for w in ws} | {u for k, u in enumerate(marked) if k not in cut})
        ids: dict[str, bytes] = {}
        for k in range(0, len(words), 100_000):
            part = words[k : k + 100_000]
            ids.update(zip(part, self.encode_words(part), strict=True))
        return [b"".join([ids[w] for w in cut[k]]) if k in cut else ids[u] for k, u in enumerate(marked)]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, where each row's begin and end), without end ids; a null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        marked = pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False)  # a mark in the text joins runs of spaces
        led = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
        return gathered(led, self.cuts, marked, self.kept, self._encode_new)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, without an end id."""
        flat, at = self.encode_column(pa.array(texts, pa.large_string()))
        return [flat[a:b].tolist() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """The library's decode(ids)."""
        return self.library.decode(ids, num_threads=1) if ids else []


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a model file; it goes once another operator keeps something."""
    hold(f"sentencepiece {path}", _CODECS.clear)
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def ended(flat: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids and borders with an end id behind each row."""
    return np.insert(flat, at[1:], end_id), at + np.arange(len(at))


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", add_end: bool = True, replace: bool = False) -> DataFrame:
    """docs with an array<int> column of ids behind its own; see the module for nulls, ties and empty input.

    A column of docs that has the name given by ids raises an error, or is replaced with replace.
    """
    if ids in docs.columns and not replace:
        raise ValueError(f"the input already has a column {ids}")
    kept = [k for k, c in enumerate(docs.columns) if c != ids]
    at_text = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for whole in batches:
            for a, b in parts_of(whole.column(at_text), PART_CHARS):
                batch = whole.slice(a, b - a)
                flat, at = c.encode_column(batch.column(at_text))
                if add_end:
                    flat, at = ended(flat, at, c.end_id)
                made = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), made], [*(docs_names[k] for k in kept), ids])

    docs_names = docs.columns
    return numbered(docs).mapInArrow(run, T.StructType([*(docs.schema.fields[k] for k in kept), T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def digests(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Ids are encoded, hashed and decoded in the same task, so that they never cross a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        names = [str(i) for i in range(len(c.pieces))]
        for batch in batches:
            for a, b in parts_of(batch.column(1), PART_CHARS):
                flat, at = ended(*c.encode_column(batch.column(1).slice(a, b - a)), c.end_id)
                encoded = [flat[i:j].tolist() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                decoded = c.decode(encoded)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).cast(pa.int64()),
                        pa.array(np.diff(at), pa.int64()),
                        pa.array([hashlib.sha256(" ".join([names[i] for i in e]).encode()).hexdigest() for e in encoded], pa.string()),
                        pa.array([hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for d in decoded], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    slim = docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text")
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
