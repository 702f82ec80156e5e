"""Operator 8: near-duplicate groups by SetSketch registers, banding, likelihood and exact verification.

1. One pass over Arrow buffers gives each document its distinct shingles, an order-free 128-bit digest of
   them, and REGISTERS registers: register i is floor(1 - log_b(x)) of the smallest of the shingles'
   exponential hashes x, truncated to [0, q + 1]. Registers of a union are the larger of both, and two
   sets agree in a register with a probability close to their Jaccard similarity.
2. Documents with one digest, size and text hash, so exact copies, form a class; its smallest doc_id stands for
   it from here on. Other texts with the same set are linked like near copies, on their full sets.
3. BANDS bands of ROWS registers put representatives into buckets. A pair at the threshold misses all
   bands with probability (1 - 0.8**ROWS)**BANDS, below 1e-6 here.
4. Each bucket first links its members to one centre, the member that meets most others over all bands.
   Verified links are merged into components. Then the pairs of a bucket that still lie in different
   components are tried as well, so a link that the centres miss isn't lost; pairs inside a component need
   no trial, which is what keeps large groups of near copies linear. Buckets over BLOCK members are split
   into pairs of blocks, so that no task holds a bucket.
5. Before a pair's texts are fetched, its similarity is estimated by maximum likelihood from the counts of
   larger, smaller and equal registers and both set sizes; pairs far below the threshold go.
6. Remaining pairs are verified on their full shingle sets: texts are sent to salted groups of the pair's
   first document, where each task streams them and holds one set at a time.

Defined results: a null or wordless text has an empty set and is linked with nothing (its component is
itself); fewer words than a shingle form one shingle; rows repeated exactly share a component; a null
doc_id gets a null component and is kept, linked with nothing; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.llm import _words
from sessionloom.llm._shared import columns_of, drop_written, hold, unused, written
from sessionloom.llm.components import components

ROWS, BANDS = 6, 48
REGISTERS = ROWS * BANDS
#: SetSketch parameters: base, rate and largest register below truncation.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
#: A pair goes on if its estimate is this far below the threshold at most: over six standard errors.
SLACK = 0.15
BLOCK = 2048
SALT_ROWS = 256
#: Pairs a member above which a block's members are sent as groups, and the bounds of half a group.
DENSE = 4
GROUP_DOCS, GROUP_SHINGLES = 256, 1 << 18

CLASS = ["d1", "d2", "n_shingles", "text_hash"]

_SEEDS = _words.mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_ODD = _words.mixed(_SEEDS + np.uint64(5)) | np.uint64(1)


def shingles(column: pa.Array, size: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows, one row after the other; first): row r has first[r]:first[r + 1]."""
    data, offsets = _words.utf8(column)
    hashes, counts = [], []
    for a, b in _words.slices(len(column), offsets):
        d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        w = _words.find_words(d, o)
        h = _words.hash_words(w, lower)
        runs, row = _words.hash_windows(h, w, size)
        n = np.diff(w.first)
        short = np.flatnonzero((n > 0) & (n < size))
        whole = np.zeros(len(short), np.uint64)
        for k in range(size - 1):  # the whole sequence; its length tells it from longer ones
            has = n[short] > k
            whole[has] = whole[has] * np.uint64(0xD6E8FEB86659FD93) + h[w.first[short[has]] + k]
        whole = _words.mixed(whole + n[short].astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
        runs, row = np.r_[runs, whole], np.r_[row, short]
        order = np.lexsort((runs, row))
        runs, row = runs[order], row[order]
        keep = np.ones(len(runs), bool)
        keep[1:] = (runs[1:] != runs[:-1]) | (row[1:] != row[:-1])
        hashes.append(runs[keep])
        counts.append(np.bincount(row[keep], minlength=b - a))
    first = np.r_[0, np.cumsum(np.concatenate(counts))] if counts else np.zeros(1, np.int64)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), first.astype(np.int64)


def registers(hashes: np.ndarray, first: np.ndarray, chunk: int = 512) -> np.ndarray:
    """rows x REGISTERS, uint16; rows without shingles hold zeros."""
    rows = len(first) - 1
    low = np.full((rows, REGISTERS), np.iinfo(np.uint64).max, np.uint64)
    row_of = np.repeat(np.arange(rows), np.diff(first))
    for k in range(0, len(hashes), chunk):
        part, rows_here = hashes[k : k + chunk], row_of[k : k + chunk]
        x = (part[:, None] ^ _SEEDS) * _ODD
        heads = np.flatnonzero(np.r_[True, rows_here[1:] != rows_here[:-1]])
        got = np.minimum.reduceat(x, heads, axis=0)
        at = rows_here[heads]
        low[at] = np.minimum(low[at], got)
    u = (low.astype(np.float64) + 0.5) / 2.0**64
    with np.errstate(divide="ignore"):
        x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    k = np.floor(1 - np.log(x) / np.log(BASE))
    out = np.clip(k, 0, TOP + 1).astype(np.uint16)
    out[np.diff(first) == 0] = 0
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs (rows of a and b, with exact set sizes) of greatest joint likelihood, on a grid."""
    over, under = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - over - under
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    most = np.minimum(u / v, v / u)
    j = np.linspace(0.0, 1.0, 101)[None, :] * most
    p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    like = over * np.log(np.maximum(up, 1e-9)) + under * np.log(np.maximum(down, 1e-9)) + same * np.log(np.maximum(1 - up - down, 1e-9))
    return np.take_along_axis(np.broadcast_to(j, like.shape), like.argmax(axis=1)[:, None], axis=1)[:, 0]


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, d1, d2 (digest), regs of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("sketches", lambda: None)
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                b = whole.slice(k, 1024)
                hashes, first = shingles(b.column("text"), size)
                n = np.diff(first)
                sums = [np.r_[np.uint64(0), np.cumsum(x)] for x in (hashes, _words.mixed(hashes ^ np.uint64(0x9E3779B97F4A7C15)))]
                d1, d2 = ((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)
                regs = registers(hashes, first).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("text_hash"), pa.array(n), pa.array(d1), pa.array(d2), pa.array([r.tobytes() for r in regs], pa.binary())],
                    ["doc_id", "text_hash", "n_shingles", "d1", "d2", "regs"],
                )

    named = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return named.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, regs binary")


def _banded(reps: DataFrame) -> DataFrame:
    """key (of band and its registers), doc: BANDS rows a representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            regs = np.frombuffer(b"".join(b.column("regs").to_pylist()), "<u2").reshape(-1, BANDS, ROWS)
            key = np.zeros(regs.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
            for k in range(ROWS):
                key = _words.mixed(key * np.uint64(0xD6E8FEB86659FD93) + regs[:, :, k])
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(b.column("doc").to_numpy(), BANDS))], ["key", "doc"])

    return reps.select("doc", "regs").mapInArrow(run, "key long, doc long")


def _close(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs a, b those whose estimate doesn't rule them out."""
    r = reps.select("doc", "n", "regs")
    joined = pairs.join(r.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra")), "a")
    joined = joined.where(F.col("na").isNotNull()).join(r.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb")), "b")
    # Sizes alone bound the similarity.
    sized = joined.where(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            a_, b_ = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("ra", "rb"))
            e = estimate(a_, b_, b.column("na").to_numpy().astype(float), b.column("nb").to_numpy().astype(float))
            keep = pa.array(e >= threshold - SLACK)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    return sized.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b of the pairs whose full sets meet the threshold. docs: doc, text of representatives."""
    fan = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c"))
    salted = pairs.join(fan, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / SALT_ROWS)))
    asked = salted.select("a", "salt", F.col("b").alias("doc"), F.lit(1).alias("role")).unionByName(
        salted.select("a", "salt", F.col("a").alias("doc"), F.lit(0).alias("role")).distinct()
    )
    sent = asked.join(docs, "doc").select("a", "salt", "role", "doc", "text")
    dealt = sent.repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, np.zeros(0, np.uint64)
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                hashes, first = shingles(batch.column("text"), size)
                a, salt, role, doc = (batch.column(i).to_numpy() for i in (0, 1, 2, 3))
                found: list[int] = []
                for i in range(batch.num_rows):
                    mine = hashes[first[i] : first[i + 1]]
                    if role[i] == 0:
                        at, centre = (a[i], salt[i]), mine.copy()
                        continue
                    if at != (a[i], salt[i]):
                        raise RuntimeError("a pair's first text is missing")
                    place = np.minimum(np.searchsorted(centre, mine), max(0, len(centre) - 1))
                    both = int((centre[place] == mine).sum()) if len(centre) and len(mine) else 0
                    either = len(centre) + len(mine) - both
                    if both and 100 * both >= percent * either:
                        found.append(i)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(a[found]), pa.array(doc[found])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _cross(open_members: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Trials for a bucket's pairs in different components that the estimate doesn't rule out.

    Few pairs come as rows a, b. Where a block has more than DENSE pairs a member, its members come instead as
    rows a, grp: groups of bounded text whose pairs are all tried at once by _group_links. Rows therefore
    grow with members, not with pairs.
    """
    sizes = open_members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    m = open_members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    m = m.join(reps.select("doc", "n", "regs"), "doc")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = m.withColumn("with", other).select("key", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), "block", "doc", "root", "n", "regs")
    dealt = spread.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "block", "doc")

    def trials_of(g: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(g).combine_chunks()
        doc, root, n, block = (t.column(c).to_numpy() for c in ("doc", "root", "n", "block"))
        key, x, y = (t.column(c)[0].as_py() for c in ("key", "x", "y"))
        regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), "<u2").reshape(-1, REGISTERS)
        out_a: list[np.ndarray] = []
        out_b: list[np.ndarray] = []
        used = np.zeros(len(doc), bool)
        for i in range(len(doc)):
            j = np.arange(i + 1, len(doc))
            j = j[(root[j] != root[i]) & ((block[j] != block[i]) | (x == y))]
            j = j[np.minimum(n[j], n[i]) >= threshold * np.maximum(n[j], n[i]) - 1e-9]
            # A cheap bound first: few equal registers rule a pair out as the likelihood would.
            j = j[(regs[j] == regs[i]).sum(axis=1) >= (threshold - SLACK - 0.05) * REGISTERS]
            if len(j):
                e = estimate(np.broadcast_to(regs[i], (len(j), REGISTERS)), regs[j], np.full(len(j), float(n[i])), n[j].astype(float))
                j = j[e >= threshold - SLACK]
                out_a.append(np.full(len(j), i))
                out_b.append(j)
                used[i] |= len(j) > 0
                used[j] = True
        if not used.any():
            return None
        pa_, pb_ = np.concatenate(out_a), np.concatenate(out_b)
        if len(pa_) <= DENSE * used.sum():
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(doc[pa_], doc[pb_])), pa.array(np.maximum(doc[pa_], doc[pb_])), pa.nulls(len(pa_), pa.int64())], ["a", "b", "grp"])
        some = np.flatnonzero(used)
        part = np.maximum(np.cumsum(n[some]) // GROUP_SHINGLES, np.arange(len(some)) // GROUP_DOCS)
        parts = np.unique(part, return_inverse=True)[1]
        last = int(parts.max())
        members, groups = [], []
        for u in range(last + 1):
            for v in range(u, last + 1):
                if u == v and last > 0:
                    continue  # pairs inside a part are tried with each of its neighbours
                at = some[(parts == u) | (parts == v)]
                name = _words.mixed(np.array([key], np.int64).view(np.uint64) * np.uint64(31) + np.uint64(((x * 4099 + y) * 4099 + u) * 4099 + v))
                members.append(doc[at])
                groups.append(np.full(len(at), name.view(np.int64)[0]))
        a, grp = np.concatenate(members), np.concatenate(groups)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()), pa.array(grp)], ["a", "b", "grp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _runs(batches, ["key", "x", "y"]):
            if (got := trials_of(g)) is not None:
                yield got

    return dealt.mapInArrow(run, "a long, b long, grp long").distinct()


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[pa.RecordBatch]]:
    """Slices of consecutive rows that agree in names, across batches."""
    at, group = None, []
    for b in batches:
        if not b.num_rows:
            continue
        ids = np.stack([b.column(c).to_numpy().astype(np.int64) for c in names])
        cuts = np.r_[0, np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1, b.num_rows]
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            here = tuple(ids[:, s].tolist())
            if here != at and group:
                yield group
                group = []
            at = here
            group.append(b.slice(s, e - s))
    if group:
        yield group


def linked_pairs(hashes: np.ndarray, first: np.ndarray, percent: int, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that join all rows of one group which exact links connect: all intersections from products
    of 0/1 matrices over the shingles that two rows or more share, then a spanning forest of the links."""
    rows = len(first) - 1
    n = np.diff(first)
    row = np.repeat(np.arange(rows), n)
    _, column, count = np.unique(hashes, return_inverse=True, return_counts=True)
    often = count[column] > 1
    row, column = row[often], np.unique(column[often], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((rows, rows), np.float64)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, chunk):
        lo, hi = np.searchsorted(column, [c, c + chunk])
        m = np.zeros((rows, chunk), np.float32)
        m[row[lo:hi], column[lo:hi] - c] = 1.0
        both += m @ m.T
    either = n[:, None] + n[None, :] - both
    i, j = np.nonzero(np.triu((both > 0) & (100 * both >= percent * either), 1))
    tree, keep = list(range(rows)), []

    def root(v: int) -> int:
        while tree[v] != v:
            tree[v] = tree[tree[v]]
            v = tree[v]
        return v

    for k, (u, v) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        ru, rv = root(u), root(v)
        if ru != rv:
            tree[ru] = rv
            keep.append(k)
    return i[keep], j[keep]


def _group_links(groups: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: links that connect what exact links connect inside each group (grp, a). docs: doc, text."""
    sent = groups.select("grp", F.col("a").alias("doc")).join(docs, "doc").select("grp", "doc", "text")
    dealt = sent.repartition("grp").sortWithinPartitions("grp", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _runs(batches, ["grp"]):
            t = pa.Table.from_batches(g)
            doc = t.column("doc").to_numpy()
            i, j = linked_pairs(*shingles(t.column("text"), size), percent)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array(doc[j])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _components(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(sketches of all documents, classes with their component): a class has first (its smallest doc_id and
    text_hash) and low (the smallest first of its component)."""
    threshold = percent / 100
    # A class is a node (doc) whose registers and smallest document stay with it. Its number is given, not
    # hashed, so no two classes share one.
    sk = written(sketches(docs, size), "sketches")
    filled = sk.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    smallest = F.min(F.struct("doc_id", "text_hash")).alias("first")
    found = filled.groupBy(*CLASS).agg(smallest, F.max("n_shingles").alias("n"), F.max("regs").alias("regs"))
    classes = written(found.withColumn("doc", F.monotonically_increasing_id()), "classes")
    reps = classes.select("doc", "n", "regs")
    buckets = written(_banded(reps), "buckets")
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    members = written(buckets.join(shared, "key").select("key", "doc", "c"), "members")
    drop_written(buckets)
    degree = members.groupBy("doc").agg(F.sum("c").alias("degree"))
    ranked = members.select("key", "doc").join(degree, "doc")
    centre = ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("doc")).alias("minus"))).alias("m")).select("key", (-F.col("m.minus")).alias("centre"))
    stars = members.join(centre, "key").where(F.col("doc") != F.col("centre"))
    stars = written(stars.select(F.col("centre").alias("a"), F.col("doc").alias("b")).distinct(), "stars")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    where = classes.select("doc", "first.doc_id", "first.text_hash")
    near = written(_close(stars, reps, threshold), "near")
    links = written(_verified(near, _texts_of(_ends(near), where, texts), size, percent), "links")
    roots = written(components(links), "roots")
    # What the stars left open: buckets whose members still lie in different components.
    placed = members.select("key", "doc").join(roots, F.col("doc") == F.col("node"), "left").select("key", "doc", F.coalesce("root", "doc").alias("root"))
    placed = written(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where(F.col("lo") < F.col("hi")).select("key")
    trials = written(_cross(placed.join(mixed, "key"), reps, threshold), "trials")
    rest = trials.where("grp IS NULL").select("a", "b")
    rest = rest.join(near, ["a", "b"], "left_anti").join(near.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
    rest = written(rest, "rest")
    more = written(_verified(rest, _texts_of(_ends(rest), where, texts), size, percent), "links")
    groups = trials.where("grp IS NOT NULL").select("grp", "a")
    dense = written(_group_links(groups, _texts_of(groups.select(F.col("a").alias("doc")), where, texts), size, percent), "links")
    every = links.unionByName(more).unionByName(dense)
    final = written(components(every), "roots")
    of_class = classes.select(*CLASS, "doc", "first").join(final, F.col("doc") == F.col("node"), "left").select(*CLASS, "first", F.coalesce("root", "doc").alias("root"))
    lows = of_class.groupBy("root").agg(F.min("first").alias("low"))
    return sk, of_class.join(lows, "root").select(*CLASS, "first", "low")


def grouped(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    sk, named = _components(docs, size, percent)
    out = sk.select("doc_id", *CLASS).join(named.select(*CLASS, F.col("low.doc_id").alias("_low")), CLASS, "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("_low", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def representatives(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs without near copies: of each component the rows of its smallest doc_id (then text hash) stay.

    A row is judged by its doc_id and text. Rows that share both count as one, and the one with the
    smallest hash of all columns stays. Rows without words or with a null doc_id are linked with nothing.
    """
    sk, named = _components(docs.select("doc_id", "text"), size, percent)
    gone = sk.join(named, CLASS).where("doc_id IS NOT NULL").where(F.struct("doc_id", "text_hash") != F.col("low"))
    key, seen, place, gone_id, gone_hash = unused(docs.columns, "_hash", "_seen", "_place", "_gone_id", "_gone_hash")
    gone = gone.select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)).distinct()
    keyed = docs.withColumn(key, F.xxhash64("text"))
    kept = keyed.join(gone, (F.col("doc_id") == F.col(gone_id)) & (F.col(key) == F.col(gone_hash)), "left_anti")
    often = sk.groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash))
    if often.isEmpty():
        return kept.select(*columns_of(docs))
    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_hash))
    told = kept.withColumn(seen, F.xxhash64(*columns_of(docs)))
    first = F.row_number().over(W.partitionBy("doc_id", key).orderBy(seen))
    once = told.join(often, same, "left_semi").withColumn(place, first).where(F.col(place) == 1)
    return kept.join(often, same, "left_anti").select(*columns_of(docs)).unionByName(once.select(*columns_of(docs)))


def _texts_of(nodes: DataFrame, where: DataFrame, texts: DataFrame) -> DataFrame:
    """doc, text of distinct classes (column doc), from the row of their smallest document."""
    named = nodes.distinct().join(where, "doc")
    return texts.join(named, ["doc_id", "text_hash"]).select("doc", "text").dropDuplicates(["doc"])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc")))
