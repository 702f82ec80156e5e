"""Operator 2: base quality rules, then robust multivariate outliers by minimum covariance determinant.

Each document gets counts over its whole text, found on Arrow buffers. Four transformed statistics (log
mean word length, and the arcsine roots of the shares of symbols, repeated lines and repeated words) form
its vector: each as its deviation from the group's median, divided by how much wider texts of this length
spread by sampling alone than long ones. Groups are language and source; groups of fewer than min_rows
rows are pooled by language, then all together.

The estimate of a group starts from two fixed points (coordinate-wise median and spread; mean and
covariance). Concentration steps follow: distances of all rows, the distance below which a share h of the
rows lies (from counts in narrow logarithmic bins), mean and covariance of those rows, until no determinant
falls any more. The start with the smaller determinant wins. A ridge keeps the scatter regular where
most rows agree exactly, as copies do. A document is rejected if its Mahalanobis distance exceeds the cutoff.

All steps are aggregations over (group, bin) or group; no task holds a group, and a hot group combines
before each shuffle. Only the inversion of one small matrix a group runs in Python.

Defined results: a null text has no words and fails the base rules; null lang or source is a value of its
own; pools of fewer than min_rows / 8 rows get no verdict from the estimate (kept); repeated rows are
judged alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.llm import _words
from sessionloom.llm._shared import drop_written, written

MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Share of rows that the estimate rests on, and its consistency factor in four dimensions.
SHARE, CONSISTENCY = 0.75, 1.487
#: Least standard deviations (the ridge), only to keep the scatter regular.
FLOORS = (0.02, 0.02, 0.03, 0.03)
#: Spread of long texts, and what sampling adds to the variance: so much over the words (lines for x2) of a text.
#: Repeats come as whole lines, so that one makes some 32 words repeated ones.
SPREADS, SAMPLING = (0.03, 0.03, 0.05, 0.05), (0.3, 0.25, 0.5, 8.0)
#: Of the squared distance; the 0.999 quantile of chi-squared with four degrees of freedom.
CUTOFF = 18.47
MIN_ROWS, BINS = 200, 32
#: Bound of the concentration steps, which end when no determinant falls by more than the share TOLERANCE.
MOST_STEPS, TOLERANCE = 100, 1e-6
_D = 4

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.r_[0, np.cumsum(values)]
    return run[offsets[1:]] - run[offsets[:-1]]


def _repeat_words(w: _words.Words, rows: int) -> np.ndarray:
    """Words inside windows that their own row holds twice or more."""
    h = _words.hash_words(w)
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(rows, np.int64)
    key = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        key = key * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
    at = np.flatnonzero(w.row[:n] == w.row[WINDOW - 1 :])
    key = _words.mixed(key[at] + w.row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + WINDOW, -1)
    return _sums((np.cumsum(edge[:-1]) > 0).astype(np.int64), w.first)


def _lines(text: str) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier line)."""
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    return len(lines), len(lines) - len(set(lines))


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = _words.utf8(texts)
    parts = []
    for a, b in _words.slices(len(texts), offsets):
        d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        w = _words.find_words(d, o)
        points = _sums((((d & 0xC0) != 0x80) & ~_words._SPACE[d]).astype(np.int64), o)
        parts.append((np.diff(w.first), points, _sums(_SYMBOL[d], o), _repeat_words(w, b - a)))
    cols = [np.concatenate(c) if parts else np.zeros(0, np.int64) for c in (zip(*parts, strict=True) if parts else [()] * 4)]
    lines = [_lines(t) if t else (0, 0) for t in texts.to_pylist()]
    return {
        "n_words": cols[0], "word_chars": cols[1], "n_symbols": cols[2],
        "n_dup_lines": np.array([x[1] for x in lines], np.int64), "n_repeat_words": cols[3], "n_lines": np.array([x[0] for x in lines], np.int64),
    }


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = counts(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("source"), *map(pa.array, c.values())], ["doc_id", "lang", "source", *c])

    return docs.select("doc_id", "lang", "source", "text").mapInArrow(run, f"doc_id long, lang string, source string, {_STATS}")


def _key(*names: str) -> Column:
    return F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("="), F.col(n)), F.lit("~")) for n in names])


def _grouped(rows: DataFrame, min_rows: int) -> DataFrame:
    """rows with g: their own group, or a pool."""
    sizes = rows.groupBy(_key("lang", "source").alias("_own"), _key("lang").alias("_lang")).agg(F.count(F.lit(1)).alias("_n"))
    small = F.col("_n") < min_rows
    pool = F.sum(F.when(small, F.col("_n")).otherwise(0)).over(W.partitionBy("_lang"))
    g = F.when(~small, F.concat(F.lit("1"), F.col("_own"))).when(pool >= min_rows, F.concat(F.lit("2"), F.col("_lang"))).otherwise("3")
    named = written(sizes.select("_own", g.alias("g")), "groups")
    return rows.withColumn("_own", _key("lang", "source")).join(named, "_own").drop("_own")


def _vectors(rows: DataFrame) -> DataFrame:
    """g, and x0 .. x3: deviations from the medians of g, on the scale of long texts."""
    root = lambda part, whole: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(part) / F.col(whole))))
    raw = [F.log(F.col("word_chars") / F.col("n_words")), root("n_symbols", "word_chars"), root("n_dup_lines", "n_lines"), root("n_repeat_words", "n_words")]
    r = rows.withColumns({f"x{i}": F.round(c, 3) for i, c in enumerate(raw)})  # rounded, so that a median keeps few values
    middle = written(r.groupBy("g").agg(*[F.percentile(f"x{i}", 0.5).alias(f"m{i}") for i in range(_D)]), "medians")
    size = ["n_words", "n_words", "n_lines", "n_words"]
    scale = [F.sqrt(1 + SAMPLING[i] / SPREADS[i] ** 2 / F.col(size[i])) for i in range(_D)]
    return r.join(middle, "g").select(*rows.columns, *[F.round((F.col(f"x{i}") - F.col(f"m{i}")) / scale[i], 6).alias(f"x{i}") for i in range(_D)])


def _distance() -> Column:
    """Squared, from the arrays m (centre) and p (precision, row by row)."""
    c = [F.col(f"x{i}") - F.get("m", F.lit(i)) for i in range(_D)]
    return sum(c[i] * c[j] * F.get("p", F.lit(i * _D + j)) * (1.0 if i == j else 2.0) for i in range(_D) for j in range(i, _D))


def _bin(d: Column) -> Column:
    return F.floor(F.log2(F.greatest(d, F.lit(1e-9))) * BINS).cast("int")


def _quantile_bins(binned: DataFrame, keys: list[str], share: float) -> DataFrame:
    """keys, top: the lowest bin up to which at least the share of the rows lies."""
    per = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy(*keys)
    run = F.sum("c").over(w.orderBy("bin"))
    return per.select(*keys, "bin", run.alias("run"), F.sum("c").over(w).alias("all")).where(F.col("run") >= share * F.col("all")).groupBy(*keys).agg(F.min("bin").alias("top"))


def _solved(moments: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """keys, m, p, det: one small matrix inverted a row."""
    ridge = np.diag(np.square(FLOORS))
    at = [(i, j) for i in range(_D) for j in range(i, _D)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = b[[f"s{i}" for i in range(_D)]].to_numpy() / b[["n"]].to_numpy()
            cov = np.zeros((len(b), _D, _D))
            for i, j in at:
                cov[:, i, j] = cov[:, j, i] = b[f"s{i}{j}"].to_numpy() / b["n"].to_numpy() - m[:, i] * m[:, j]
            cov = cov * factor + ridge
            yield b[keys].assign(m=list(m), p=list(np.linalg.inv(cov).reshape(len(b), -1)), det=np.linalg.det(cov))

    types = ", ".join(f"{k} {dict(moments.dtypes)[k]}" for k in keys)
    return moments.mapInPandas(run, f"{types}, m array<double>, p array<double>, det double")


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    squares = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i in range(_D) for j in range(i, _D)]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(_D)], *squares)


def estimates(rows: DataFrame, steps: int = MOST_STEPS, share: float = SHARE) -> DataFrame:
    """g, n, m, p: the estimate of each group, from rows with g and x0 .. x3."""
    keys = ["g", "start"]
    # Start 0: medians and spreads, each from bins of width 0.002; start 1: all rows.
    long = rows.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(f"x{i}") / 0.002).cast("int").alias("bin")) for i in range(_D)])).alias("v"))
    binned = written(long.groupBy("g", "v.i", "v.bin").agg(F.count(F.lit(1)).alias("c")), "bins")
    w = W.partitionBy("g", "i")
    ranked = binned.withColumns({"run": F.sum("c").over(w.orderBy("bin")), "all": F.sum("c").over(w)})
    cut = lambda q: (F.min(F.when(F.col("run") >= q * F.col("all"), F.col("bin"))) + 0.5) * 0.002
    spread = ranked.groupBy("g", "i").agg(cut(0.5).alias("mid"), ((cut(0.75) - cut(0.25)) / 1.349).alias("sd"))
    floor = F.element_at(F.array(*[F.lit(f) for f in FLOORS]), F.col("i") + 1)
    arrays = spread.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "mid", (F.col("sd") * F.col("sd") + floor * floor).alias("v")))).alias("a"))
    precision = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_D - 1)), lambda i: F.transform("a", lambda x: F.when(x["i"] == i, 1.0 / x["v"]).otherwise(0.0))))
    first = arrays.select("g", F.lit(0).alias("start"), F.transform("a", lambda x: x["mid"]).alias("m"), precision.alias("p"), F.lit(0.0).alias("det"))
    params = written(first.unionByName(_solved(_moments(rows.withColumn("start", F.lit(1)), keys), keys, 1.0)), "start")
    for step in range(steps):
        d = rows.join(params.drop("det"), "g").withColumn("bin", _bin(_distance()))
        top = written(_quantile_bins(d, keys, share), "top")
        inner = d.join(top, keys).where(F.col("bin") <= F.col("top"))
        new = _solved(_moments(inner, keys), keys, CONSISTENCY)
        # A start whose determinant has stopped falling keeps its estimate; the first step has nothing to compare with.
        was = params.select(*keys, F.struct("m", "p", "det").alias("was"))
        fell = F.lit(True) if step == 0 else F.col("det") < F.col("was.det") * (1 - TOLERANCE)
        chosen = F.when(fell, F.struct("m", "p", "det")).otherwise(F.col("was"))
        moved = new.join(was, keys).select(*keys, chosen.alias("now"), fell.alias("fell"))
        new = written(moved.select(*keys, "now.*", "fell"), "step")
        going = not new.where("fell").isEmpty()
        drop_written(params)
        drop_written(top)
        params = new.drop("fell")
        params._written_at = new._written_at
        if not going:
            break
    best = params.groupBy("g").agg(F.min(F.struct("det", "start", "m", "p")).alias("b")).select("g", "b.m", "b.p")
    n = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return best.join(n, "g")


def judged(docs: DataFrame, min_rows: int = MIN_ROWS, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, the counts, base_failed, distance2 (null if base_failed or without an estimate) and kept."""
    stats = written(statistics(docs), "stats")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    passed = _grouped(stats.where(~failed), min_rows)
    rows = written(_vectors(passed), "vectors")
    params = written(estimates(rows).where(F.col("n") >= min_rows / 8), "estimate")
    d = rows.join(params.select("g", "m", "p"), "g", "left").withColumn("distance2", _distance())
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    good = d.select(*columns, F.lit(False).alias("base_failed"), (F.col("distance2").isNull() | (F.col("distance2") <= cutoff)).alias("kept"), "distance2")
    bad = stats.where(failed).select(*columns, F.lit(True).alias("base_failed"), F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance2"))
    return good.unionByName(bad)
