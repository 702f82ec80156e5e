"""Operator 5: language identification by script narrowing and Viterbi over per-word scores.

Learning: a bounded sample of whole labelled documents (sample_docs a language, by hash) gives counts of
character 1- to 4-grams and whole words per language, and the scripts that each language uses. A word's
score in a language is the sum of its grams' log probabilities, less the best language's, and bounded.

Prediction: letters' script ranges narrow each word's candidates. The labels of a document's words are
the best path over all words, where each change of language costs switch_cost; runs of one label are the
spans of a mixed-language text. A document gets the language with the most letters; its score is that
language's share of all letters, lessened by letters in words that say nothing about any language.
Documents in which no stretch of words favours another language by half a switch need no search: their
path is proven to stay in one language.

Defined results: `und` with score 0 for a null text or one without letters, or where nothing could be
learned; ties go to the language first in code-point order; repeated rows get equal results; a null lang
teaches nothing; other columns are never inputs, and those named like the two new ones are replaced by
them; an empty table gives an empty result; a very long text is labelled whole, with a byte kept for each
word and language of those that need the search.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.llm._shared import give_back, hold, numbered, parts_of
from sessionloom.llm._words import mixed

SAMPLE_DOCS = 400
SWITCH_COST = 14.0
WORST = 6.0
FOLDS, HELD_OUT = 3, 1
_WORDS = re.compile(r"[^\W\d_]+").findall
#: Words kept by a task, and characters of text labelled at once.
KEPT_WORDS, PART_CHARS = 250_000, 1_000_000

#: First and last code points of scripts.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x531, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}


def script_of(word: str) -> str:
    """The script of a word's first letter that has one; `other` without."""
    if word.isascii():
        return "latin" if any(map(str.isalpha, word)) else "other"
    for c in word:
        p = ord(c)
        for name, ranges in SCRIPTS.items():
            if any(a <= p <= b for a, b in ranges):
                return name
    return "other"


def grams(word: str) -> list[str]:
    marked = f"^{word}$"
    return [marked[k : k + n] for n in (1, 2, 3, 4) for k in range(len(marked) - n + 1)] + [f"={word}"]


def gram_hashes(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of its word) of every n-gram of ^word$, from code points at once."""
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    points = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    m = len(points) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(m, n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + points[k : k + m]
    whole = word[:m] == word[n - 1 :]
    return mixed(h[whole]), word[:m][whole]


@dataclass
class Model:
    """Bounded by the sample: log probabilities by sorted gram hash and by word, one allowed-language mask a script."""

    langs: list[str]
    hashes: np.ndarray
    table: np.ndarray
    words: dict[str, int]
    word_table: np.ndarray
    scripts: dict[str, np.ndarray]

    def scores(self, words: list[str]) -> np.ndarray:
        """words x languages: 0 for the best and -WORST at least; all 0 if a word says nothing."""
        low = [w.lower() for w in words]
        langs = len(self.langs)
        s = np.zeros((len(low), langs))
        for n in (1, 2, 3, 4) if len(self.hashes) else ():
            h, word = gram_hashes(low, n)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            at, word = at[hit], word[hit]
            for k in range(langs):
                s[:, k] += np.bincount(word, self.table[at, k], len(low))
        known = [(k, i) for k, i in enumerate(map(self.words.get, low)) if i is not None]
        if known:
            k, i = np.array(known).T
            s[k] += self.word_table[i]
        names = list(self.scripts)
        masks = np.array([*self.scripts.values(), np.zeros(langs, bool)])
        number = {name: k for k, name in enumerate(names)}
        allowed = masks[np.fromiter((number.get(script_of(w), len(names)) for w in low), np.int64, len(low))]
        silent = ~allowed.any(axis=1)
        s = np.where(allowed, s, -np.inf)
        s[silent] = 0.0
        return np.maximum(s - s.max(axis=1, keepdims=True), -WORST).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """From doc_id, text, lang. A hash thins each language to about the bound before any row is ranked."""
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0)), {}, np.zeros((0, 0)), {})
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(1 << 30))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(math.ceil((1 << 30) * min(1.0, 1.5 * sample_docs / n))))])
    thin = rows.where(draw < share[F.col("lang")]).select("text", "lang", draw.alias("_draw"))
    some = thin.withColumn("_k", F.row_number().over(W.partitionBy("lang").orderBy("_draw", "text"))).where(F.col("_k") <= sample_docs)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                words = Counter(w for t in texts for w in _WORDS(t.lower()))
                found: Counter[str] = Counter()
                for w, n in words.items():
                    found[f"#{script_of(w)}"] += n
                    for g in grams(w):
                        found[g] += n
                yield pd.DataFrame({"lang": lang, "gram": list(found), "n": list(found.values())})

    counted = some.select("lang", "text").mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    common = counted.where(F.col("n") >= 2).toPandas()  # bounded by sample_docs and the number of languages
    langs = sorted(sizes)
    col = {k: i for i, k in enumerate(langs)}
    script = common["gram"].str.startswith("#") & (common["gram"].str.len() > 1)
    per_script = common[script].assign(gram=common["gram"].str[1:]).pivot_table(index="gram", columns="lang", values="n", fill_value=0).reindex(columns=langs, fill_value=0)
    shares = per_script.to_numpy() / np.maximum(1, per_script.to_numpy().sum(axis=0))
    scripts = {s: shares[k] >= 0.01 for k, s in enumerate(per_script.index)}
    text = common[~script]
    names = text["gram"].unique()
    index = {g: k for k, g in enumerate(names)}
    table = np.zeros((len(names), len(langs)))
    np.add.at(table, (text["gram"].map(index).to_numpy(int), text["lang"].map(col).to_numpy(int)), text["n"].to_numpy(float))
    # Each gram length has a distribution of its own; 0.5 is added to every count.
    kind = np.array([5 if g[0] == "=" and len(g) > 1 else len(g) for g in names])
    for k in np.unique(kind):
        at = kind == k
        table[at] = np.log((table[at] + 0.5) / (table[at].sum(axis=0) + 0.5 * at.sum()))
    grams_at = np.flatnonzero(kind < 5)
    hashes = np.zeros(len(names), np.uint64)
    for n in (1, 2, 3, 4):
        at = np.flatnonzero(kind == n)
        points = np.frombuffer("".join(names[at]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(len(at), n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0xD6E8FEB86659FD93) + points[:, k]
        hashes[at] = mixed(h)
    order = grams_at[np.argsort(hashes[grams_at])]
    whole = np.flatnonzero(kind == 5)
    return Model(langs, hashes[order], table[order], {names[k][1:]: i for i, k in enumerate(whole.tolist())}, table[whole], scripts)


def best_paths(scores: np.ndarray, first: np.ndarray, cost: float) -> np.ndarray:
    """Labels of all words; document r has rows first[r]:first[r + 1] of scores (words x languages)."""
    n, langs = scores.shape
    out = np.zeros(n, np.int16)
    sizes = np.diff(first)
    docs = np.flatnonzero(sizes > 0)
    if langs < 2 or not len(docs):
        return out
    run = np.zeros((n + 1, langs))
    np.cumsum(scores, axis=0, dtype=np.float64, out=run[1:])
    lead = (run[first[docs + 1]] - run[first[docs]]).argmax(axis=1)
    doc_of = np.repeat(np.arange(len(docs)), sizes[docs])
    out[:] = lead[doc_of]
    # Largest sum over any stretch of words by which another language beats the leading one.
    ahead = np.cumsum(scores - scores[np.arange(n), out][:, None], axis=0, dtype=np.float64)
    step = ahead.max() - ahead.min() + 1.0
    fall = -step * doc_of[:, None]  # lets one running minimum start anew at each document
    low = np.minimum.accumulate(np.vstack([np.zeros((1, langs)), ahead])[:-1] + fall, axis=0) - fall
    gain = np.maximum.reduceat((ahead - low).max(axis=1), first[docs])
    hard = docs[gain > cost / 2]
    hard = hard[np.argsort(-sizes[hard], kind="stable")]
    if not len(hard):
        return out
    at, size = first[hard], sizes[hard]
    steps = int(size[0])
    active = np.searchsorted(-size, -np.arange(steps), "left")  # documents longer than t
    # The language before each word's, for every language of it: a byte or two each, documents one after the other.
    base = np.r_[0, np.cumsum(size)[:-1]]
    came = np.empty((int(size.sum()), langs), np.uint8 if langs < 256 else np.int16)
    each, every = np.arange(len(hard)), np.arange(langs, dtype=came.dtype)
    v = np.zeros((len(hard), langs))
    for t in range(steps):
        a = int(active[t])
        v = v[:a]
        top = v.argmax(axis=1).astype(came.dtype)
        over = v[each[:a], top][:, None] - cost
        stay = v >= over
        came[base[:a] + t] = np.where(stay, every, top[:, None])
        v = np.where(stay, v, over) + scores[at[:a] + t]
        if t + 1 == steps or active[t + 1] < a:
            gone = int(active[t + 1]) if t + 1 < steps else 0
            out[at[gone:a] + t] = v[gone:].argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        a = int(active[t])
        out[at[:a] + t - 1] = came[base[:a] + t, out[at[:a] + t]]
    return out


class Labeller:
    """Word scores of a model, kept for one Python task; when full, only the present texts' words stay."""

    def __init__(self, model: Model, cost: float = SWITCH_COST):
        self.model, self.cost = model, cost
        self._empty()

    def _empty(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.langs)), np.float32)
        self.letters = np.zeros(0, np.int64)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of each word in self.rows, letters of each word, first)."""
        split = [_WORDS(t) if t else [] for t in texts]
        new = {w for ws in split for w in ws}.difference(self.ids)
        if len(self.ids) + len(new) > KEPT_WORDS:
            now = sorted({w for ws in split for w in ws}.intersection(self.ids))
            at = np.array([self.ids[w] for w in now], np.int64)
            self.ids, self.rows, self.letters = dict(zip(now, range(len(now)), strict=True)), self.rows[at], self.letters[at]
        if new:
            new = sorted(new)
            self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
            for k in range(0, len(new), 20_000):
                self.rows = np.vstack([self.rows, self.model.scores(new[k : k + 20_000])])
            self.letters = np.r_[self.letters, [len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in new]].astype(np.int64)
        ids = np.array([i for ws in split for i in map(self.ids.__getitem__, ws)], np.int64)
        return ids, self.letters[ids], np.r_[0, np.cumsum([len(ws) for ws in split])].astype(np.int64)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.model.langs:
            return [("und", 0.0)] * len(texts)
        ids, letters, first = self.words(texts)
        langs = len(self.model.langs)
        scores = self.rows[ids] if len(ids) else np.zeros((0, langs), np.float32)
        labels = best_paths(scores, first, self.cost)
        row = np.repeat(np.arange(len(texts)), np.diff(first))
        per = np.bincount(row * langs + labels, letters, len(texts) * langs).reshape(-1, langs)
        mute = scores.max(axis=1) == scores.min(axis=1) if langs > 1 and len(ids) else np.zeros(len(ids), bool)
        silent = np.bincount(row, letters * mute, len(texts))
        total = per.sum(axis=1)
        best = per.argmax(axis=1)
        share = per[np.arange(len(texts)), best] / np.maximum(1, total)
        score = share * (1 - silent / np.maximum(1, total) * (1 - 1 / langs))
        return [(self.model.langs[b], float(s)) if t else ("und", 0.0) for b, s, t in zip(best.tolist(), score.tolist(), total.tolist(), strict=True)]

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, language) of each stretch of words of one language, in code points."""
        ids, _, first = self.words([text])
        if not len(ids) or not self.model.langs:
            return []
        labels = best_paths(self.rows[ids], first, self.cost).tolist()
        out: list[tuple[int, int, str]] = []
        for m, k in zip(re.finditer(r"[^\W\d_]+", text), labels, strict=True):
            lang = self.model.langs[k]
            if out and out[-1][2] == lang:
                out[-1] = (out[-1][0], m.end(), lang)
            else:
                out.append((m.start(), m.end(), lang))
        return out


def predicted(docs: DataFrame, model: Model, cost: float = SWITCH_COST, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs (or the columns named in keep) with the predicted language and its score, from text alone.

    names are those of the two new columns; columns of docs with these names are replaced. One pass over
    the texts, and nothing stays in the worker when a task ends.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was learned from
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    places, at_text = [docs.columns.index(c) for c in kept], docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("language", lambda: None)
        labeller = Labeller(shared.value, cost)
        for whole in batches:
            for a, b in parts_of(whole.column(at_text), PART_CHARS):
                part = whole.slice(a, b - a)
                langs, scores = zip(*labeller.predict([t or "" for t in part.column(at_text).to_pylist()]), strict=True)
                made = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in places), *made], [*kept, *names])
        del labeller
        give_back()

    fields = [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]
    return numbered(docs).mapInArrow(run, T.StructType([*(docs.schema.fields[k] for k in places), *fields]))


def identified(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns only from documents that are not held out."""
    slim = docs.select("doc_id", "text", "lang")
    model = learn(slim.where(~held_out(F.col("doc_id"))), sample_docs)
    asked = slim.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predicted(asked, model, keep=["doc_id", "held_out"])
