"""Corpus operators against brute force on small tables, with nulls, ties, repeats and empty input."""

import collections
import hashlib
import importlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import bm25_search, chat_format, language_id, line_dedup, quality_mcd, queries, setsketch_dedup, source_mix
from sessionloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def frame(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in ("size", "score", "key", "doc", "_id", "kept")}) if extra else df


ODD = [(1, None, "a"), (2, "", "a"), (3, "one", None), (3, "one", None), (4, "a b c", "b"), (None, "null id text here", "b"), (5, " \n\t ", "c"), (6, "word " * 20_000, "a"), (7, "É ü 日本 123 !!", "a")]


@pytest.mark.parametrize("name", ["op4_url_filter", "op6_chat_format", "op7_bm25_search", "op10_line_dedup"])
def test_oracles(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, sf_dir), c.sql(queries.ORACLES[name])
    key = lambda cols, rows: sorted(tuple("" if r[cols.index(k)] is None else str(r[cols.index(k)]) for k in sorted(cols)) for r in rows)
    assert key(df.columns, df.collect()) == key(want.columns, want.fetchall())


# --- op2 ---
def plain_counts(t):
    w = WORD.findall(t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    mark = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(mark)


def test_quality(spark, docs):
    texts = [r["text"] for r in docs.collect()] + [None, "", "a b\na b\n\n \na b", "x " * 100, "<é>#*$%&| é"]
    c = quality_mcd.counts(pa.array(texts))
    got = list(zip(*[c[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], strict=True))
    assert got == [plain_counts(t) for t in texts]
    out = quality_mcd.judged(frame(spark, ODD, extra=True)).collect()
    assert len(out) == len(ODD) and all(r["base_failed"] and not r["kept"] for r in out if r["n_words"] < 20)
    assert quality_mcd.judged(frame(spark, ODD).limit(0)).count() == 0


def test_outliers_leave_clean_documents(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(500)]
    prose = lambda n, mark="": " ".join(r.choice(words) + mark for _ in range(n))
    rows = [(i, prose(r.randrange(30, 800)), "s") for i in range(600)] + [(1000 + i, prose(400, "###"), "s") for i in range(40)]
    rows += [(2000 + i, "copied text of twenty words or more one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "t") for i in range(300)]
    kept = {x["doc_id"]: x["kept"] for x in quality_mcd.judged(frame(spark, rows)).collect()}
    assert all(v for k, v in kept.items() if k < 1000 or k >= 2000)
    assert not any(v for k, v in kept.items() if 1000 <= k < 2000)


def test_outliers_of_short_junk(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(2000)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    sign = lambda n: " ".join("".join(r.choice("#*$%&|<>") for _ in range(5)) for _ in range(n))
    mixed = lambda n, share: " ".join(sign(1) if r.random() < share else r.choice(words) for _ in range(n))
    rows = [(i, "\n".join(line(8) for _ in range(r.randrange(3, 100))), "s") for i in range(800)]
    junk = [sign(20), sign(28), mixed(60, 0.5), mixed(200, 0.2), mixed(200, 0.5), sign(200)]
    # Repeated lines between others: no eight-word window is held twice.
    junk.append("\n".join(x for _ in range(25) for x in ("same line", line(6))))
    rows += [(1000 + i, t, "s") for i, t in enumerate(junk)]
    kept = {x["doc_id"]: x["kept"] for x in quality_mcd.judged(frame(spark, rows)).collect()}
    assert not [k for k, v in kept.items() if k >= 1000 and v]
    assert sum(not kept[i] for i in range(800)) <= 8


def test_estimate_stops_where_no_step_lowers_the_determinant(spark):
    x = np.random.default_rng(0).uniform(-1, 1, (6000, 4))
    rows = spark.createDataFrame([("a", *map(float, v)) for v in x], "g string, x0 double, x1 double, x2 double, x3 double").cache()
    e = quality_mcd.estimates(rows).first()
    m, p = np.array(e["m"]), np.array(e["p"]).reshape(4, 4)
    d = np.einsum("ni,ij,nj->n", x - m, p, x - m)
    bins = np.floor(np.log2(np.maximum(d, 1e-9)) * quality_mcd.BINS)
    inner = x[bins <= np.sort(bins)[int(np.ceil(quality_mcd.SHARE * len(x))) - 1]]
    again = np.cov(inner.T, bias=True) * quality_mcd.CONSISTENCY + np.diag(np.square(quality_mcd.FLOORS))
    assert np.linalg.det(again) >= (1 - 2e-6) / np.linalg.det(p)


# --- op5 ---
def test_language(spark, sf_dir, docs):
    out = language_id.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)
    odd = {r["doc_id"]: r for r in language_id.identified(frame(spark, ODD)).collect()}
    assert odd[1]["lang_pred"] == odd[2]["lang_pred"] == odd[5]["lang_pred"] == "und" and odd[1]["score"] == 0
    assert language_id.identified(docs.limit(0)).count() == 0
    unlabelled = language_id.identified(frame(spark, ODD).withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_spans(docs):
    model = language_id.learn(docs.select("doc_id", "text", "lang"))
    some = {r["lang"]: r["text"] for r in docs.where("length(text) between 500 and 900").collect()}
    text = some["en"] + "\n" + some["de"]
    spans = language_id.Labeller(model).spans(text)
    assert [s[2] for s in spans] == ["en", "de"] and abs(spans[1][0] - len(some["en"])) < 40


def plain_path_value(scores, cost):
    v = np.zeros(scores.shape[1])
    for s in scores:
        v = np.maximum(v, v.max() - cost) + s
    return v.max()


def test_viterbi_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(40):
        first = np.r_[0, np.cumsum(rng.integers(0, 40, 12))]
        s = -rng.random((first[-1], 4)).astype(np.float32) * 2
        for i in range(0, first[-1], 7):
            s[i : i + 7, rng.integers(4)] += rng.random() * 2
        labels = language_id.best_paths(s, first, 2.0)
        for a, b in zip(first, first[1:], strict=False):
            if b > a:
                value = s[np.arange(a, b), labels[a:b]].sum() - 2.0 * (labels[a + 1 : b] != labels[a : b - 1]).sum()
                assert value == pytest.approx(plain_path_value(s[a:b], 2.0), abs=1e-3)


# --- op6 ---
def test_chat(spark):
    odd = ["</s>[INST] ok [/INST]", "<\\/s> <s> \\", "[\\\\INST]", None, "", "plain\n\n", "[[INST]]"]
    rows = [(c, k, role, t) for c, t in enumerate(odd) for k, role in enumerate(["user", "assistant", "user", "assistant", "system"][: c % 5 + 1])] + [(99, 0, "assistant", "x"), (99, 0, "assistant", "x"), (None, 0, None, "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("example", F.lit(1))
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.expand(df)).collect()}
    want = collections.defaultdict(list)
    for c, _, role, t in rows:
        want[c].append((role or "", t or ""))
    assert set(got) == set(want)
    for c, ts in want.items():
        loss = "".join(t for role, t in ts if role == "assistant")
        assert got[c]["n_turns"] == len(ts) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.digests(chat_format.expand(df.limit(0))).count() == 0


# --- op7 ---
def test_search_prunes_exactly():
    r = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choices(words, weights=[1 / (i + 1) for i in range(300)], k=r.randrange(0, 80))) for _ in range(500)]
    shard = bm25_search.Shard(list(range(500)), pa.array(texts), 40.0)
    for q in texts[:60]:
        _, terms, n, _ = bm25_search.terms_of(pa.array([q]))
        if not len(terms):
            continue
        w = np.rint(n * 1024 * 1.5)
        docs_, scores = shard.top(terms, w, 10)
        shard.weight[np.searchsorted(shard.terms, terms)] = w
        every = shard.full(np.arange(500))
        shard.weight[:] = 0
        order = np.lexsort((shard.tie, -every))[:10]
        assert docs_.tolist() == order[every[order] > 0].tolist() and scores.tolist() == every[order][every[order] > 0].tolist()


def zipf_texts(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    return [" ".join(r.choices(words, weights=[1 / (i + 1) for i in range(3000)], k=r.randrange(0, 120))) for _ in range(n)]


def test_search_scores_few_documents_in_full():
    texts = zipf_texts(2000, 5)
    shard = bm25_search.Shard(list(range(2000)), pa.array(texts), 60.0)
    seen, plain = [], shard.full
    shard.full = lambda docs, *more: seen.append(len(docs)) or plain(docs, *more)
    asked = [q for q in texts[:50] if q]
    for q in asked:
        _, terms, n, _ = bm25_search.terms_of(pa.array([q]))
        shard.top(terms, n * 1.5, 10)
    assert sum(seen) <= 30 * len(asked)


def test_search_in_batches_keeps_thresholds_of_earlier_shards():
    texts = [*zipf_texts(900, 6), "only one has zebra", "", *["the same text twice"] * 30]
    half = len(texts) // 2
    shards = [bm25_search.Shard(list(range(a, b)), pa.array(texts[a:b]), 60.0) for a, b in ((0, half), (half, len(texts)))]
    assert all(s.dense.shape[1] and len(s.p_doc) for s in shards)
    _, terms, n, _ = bm25_search.terms_of(pa.array(texts))
    row = bm25_search.terms_of(pa.array(texts))[0]
    weights = n * np.random.default_rng(1).uniform(0.01, 9, len(n))
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    floors = np.zeros(len(texts))
    got = [list(s.tops(first, terms, weights, 10, floors)) for s in shards]
    for q in range(0, len(texts), 7):
        t, w = terms[first[q] : first[q + 1]], weights[first[q] : first[q + 1]]
        every = []
        for s in shards:
            at = np.minimum(np.searchsorted(s.terms, t), len(s.terms) - 1)
            s.weight[at[s.terms[at] == t]] = w[s.terms[at] == t]
            every += [(-x, s.doc_ids[d]) for d, x in enumerate(s.full(np.arange(len(s.doc_ids))).tolist()) if x > 0]
            s.weight[:] = 0
        found = [(-x, s.doc_ids[d]) for s, out in zip(shards, got, strict=True) for d, x in zip(*(v.tolist() for v in out[q]), strict=True)]
        assert sorted(found)[:10] == sorted(every)[:10]


def test_search_shards_agree(spark, docs):
    d = docs.select("doc_id", "text")
    a = bm25_search.searched(d, d.where("doc_id % 20 = 0"), docs_per_shard=1000).orderBy("query_id", "rank").collect()
    b = bm25_search.searched(d, d.where("doc_id % 20 = 0"), docs_per_shard=37).orderBy("query_id", "rank").collect()
    assert a == b
    odd = frame(spark, ODD, extra=True)
    assert bm25_search.searched(odd, odd).where("query_id = 4").count() >= 1
    assert bm25_search.searched(odd.limit(0), odd.limit(0)).count() == 0


def test_search_gives_k_rows_a_query_whatever_the_shards(spark, docs):
    d = docs.select("doc_id", "text")
    asked = d.where("doc_id % 20 = 0")
    rows = [bm25_search.found(d, asked, 3, size, tasks=1).count() for size in (1000, 37)]
    assert rows[0] == rows[1] <= 3 * asked.count()
    split = bm25_search.found(d, asked, 3, 37, tasks=4).groupBy("query_id", "text_hash").count().agg({"count": "max"}).first()[0]
    assert 3 < split <= 12


def test_search_tasks_keep_thresholds_of_earlier_shards():
    texts = zipf_texts(1200, 8)
    ids = [None, *range(1, 1200)]
    shards = [bm25_search.Shard(ids[a : a + 200], pa.array(texts[a : a + 200]), 60.0) for a in range(0, 1200, 200)]
    row, terms, n, _ = bm25_search.terms_of(pa.array(texts[:40]))
    first, best, seen = np.searchsorted(row, np.arange(41)), bm25_search.Best(40, 5), []
    for s in shards:
        plain, scored = s.full, []
        s.full = lambda docs, *more, f=plain, to=scored: to.append(len(docs)) or f(docs, *more)
        for q, (at, scores) in enumerate(s.tops(first, terms, n * 1.5, 5, best.floors)):
            best.add(q, scores, s.ids[at], s.known[at])
        seen.append(sum(scored))
    assert max(seen[3:]) < seen[0] / 2
    whole = bm25_search.Shard(ids, pa.array(texts), 60.0)
    for q, (at, scores) in enumerate(whole.tops(first, terms, n * 1.5, 5, np.zeros(40))):
        assert best.scores[q, : best.n[q]].tolist() == scores.tolist()
        assert [i if k else None for i, k in zip(best.ids[q].tolist(), best.known[q].tolist(), strict=True)][: best.n[q]] == [whole.doc_ids[d] for d in at.tolist()]


def test_search_index_holds_every_document_once(spark, tmp_path):
    d = spark.createDataFrame([(i if i else None, f"word{i} common" if i % 9 else "") for i in range(200)] + [(500, None)], "doc_id long, text string")
    for df in (d.repartition(1), d.repartition(40)):
        made = bm25_search._indexed(df, 32)
        assert sum(x[1] for x in made) == 200 and sum(x[2] for x in made) == 2 * 177 and all(x[1] <= 48 for x in made)
        opened = [bm25_search.load(*bm25_search.file_system(x[0])) for x in made]
        assert sorted(i for x in opened for i in x["ids"].tolist()) == list(range(200)) and sum((~x["known"]).sum() for x in opened) == 1
        assert len(made) <= 8
    fs = pa.fs.SubTreeFileSystem(str(tmp_path), pa.fs.LocalFileSystem())  # read as a remote one
    x = bm25_search.index([1, 2], [bm25_search.terms_of(pa.array(["", ""]))])
    bm25_search.save(fs, "x", x)
    back = bm25_search.load(fs, "x")
    assert all(back[k].dtype == v.dtype and back[k].tolist() == v.tolist() for k, v in x.items())
    assert list(bm25_search.load(fs, "x", "terms", "df")) == ["terms", "df"]


def test_search_asks_every_text_of_a_doc_id(spark):
    d = spark.createDataFrame([(20, "red fox"), (20, "blue whale"), (20, "red fox"), (1, "a red fox runs"), (2, "one blue whale")], "doc_id long, text string")
    out = bm25_search.searched(d, d.where("doc_id = 20"), docs_per_shard=2).collect()
    assert {r["doc_id"] for r in out} == {1, 2, 20}
    assert sorted(r["rank"] for r in out) == [1, 1, 2, 2, 3]


# --- op8 ---
def plain_groups(rows, size):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    tree = {i: i for i in sets}

    def root(x):
        while tree[x] != x:
            x = tree[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                tree[b] = a
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def near_copies(seed=5, base=60, n=150, edits=9):
    """One text and copies of it, most of which resemble the text more than each other."""
    r = random.Random(seed)
    text = [f"t{r.randrange(9999)}" for _ in range(base * 4)]
    out = [(0, " ".join(text))]
    for k in range(1, n):
        t = list(text)
        for _ in range(r.randrange(edits)):
            t[r.randrange(len(t))] = f"e{r.randrange(9999)}"
        out.append((k, " ".join(t)))
    return out


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, docs, size):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows += [(10_000 + i, t) for i, t in near_copies()] + [(20_000 + i, t) for i, t in near_copies(9, 20, 120, 14)] + [(30_000, None), (30_001, ""), (30_002, "a b"), (30_003, "A  B"), (30_004, "a b c")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n int, regs int")
    want, sizes = plain_groups(rows, size)
    got = {r["doc_id"]: r for r in setsketch_dedup.grouped(df, size).collect()}
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert {k: r["n_shingles"] for k, r in got.items()} == sizes
    assert all(r["kept"] == (r["component_id"] == k) for k, r in got.items())


def test_near_duplicates_by_groups(spark, monkeypatch):
    rows = near_copies(11, 15, 200, 16)
    want, _ = plain_groups(rows, 4)
    for name, value in (("DENSE", 0), ("GROUP_DOCS", 16), ("BLOCK", 64), ("SALT_ROWS", 8)):
        monkeypatch.setattr(setsketch_dedup, name, value)
    got = {r["doc_id"]: r["component_id"] for r in setsketch_dedup.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_near_duplicates_odd(spark):
    got = setsketch_dedup.grouped(frame(spark, ODD, extra=True)).collect()
    assert len(got) == len(ODD)
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    assert setsketch_dedup.grouped(frame(spark, ODD).limit(0)).count() == 0


def test_registers_merge_and_estimate():
    r = np.random.default_rng(4)
    pool = r.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[400:2400])
    regs = setsketch_dedup.registers(np.r_[a, b], np.array([0, 2000, 4000]))
    union = np.unique(np.r_[a, b])
    assert (setsketch_dedup.merged(regs[0], regs[1]) == setsketch_dedup.registers(union, np.array([0, len(union)]))[0]).all()
    e = setsketch_dedup.estimate(regs[:1], regs[1:], np.array([2000.0]), np.array([2000.0]))
    assert abs(e[0] - 1600 / 2400) < 0.1


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000 + k) for k in range(1, 50)]
    tree = {}

    def root(x):
        tree.setdefault(x, x)
        while tree[x] != x:
            x = tree[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        tree[y] = x
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in tree if n in got} and all(root(n) == n and all(a == b for a, b in edges if n in (a, b)) for n in set(tree) - set(got))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- op9 ---
def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, full, target = sum(sizes.values()), set(), {}
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        w = sum(weight[s] for s in free)
        target = {s: left * weight[s] / w for s in free} | {s: 3.0 * sizes[s] for s in full}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix(spark, docs):
    rare = frame(spark, [(90_000 + i, "w " * 40, "tiny") for i in range(5)] + [(91_000, "x y", None), (91_001, None, "void"), (91_002, "", "tiny")])
    d = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(rare)
    out = source_mix.mixed(d, copies=True).collect()
    again = source_mix.mixed(d.repartition(7), copies=True).collect()
    assert sorted(out, key=str) == sorted(again, key=str)
    texts = {r["doc_id"]: r for r in d.collect()}
    sizes, taken = collections.Counter(), collections.Counter()
    for r in out:
        s = texts[r["doc_id"]]["source"]
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]]["text"] or "")) and 0 <= r["taken"] <= 3 * r["size"] and 0 <= r["copies"] <= 3
        sizes[s] += r["size"]
        taken[s] += r["taken"]
    want = plain_targets(sizes)
    for r in out:
        assert r["target"] == pytest.approx(want[texts[r["doc_id"]]["source"]])
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(2 * source_mix.BLOCK_WORDS, 0.02 * t), s
    assert source_mix.mixed(d.limit(0)).count() == 0
    assert len(source_mix.mixed(frame(spark, ODD, extra=True), copies=True).collect()) == len(ODD)


def test_webster_takes_highest_quotients(spark):
    r = random.Random(6)
    for total in (0, 1, 7, 100, 1000):
        cells = [("g", k, float(r.randrange(0, 500)), total) for k in range(23)]
        df = spark.createDataFrame(cells, "g string, k int, w double, t int")
        got = {x["k"]: x["seats"] for x in source_mix.webster(df, ["g"], [F.col("k")], "w", "t").collect()}
        seats = collections.Counter()
        for _ in range(total):
            best = max(range(23), key=lambda k: (cells[k][2] / (2 * seats[k] + 1), -k))
            seats[best] += 1
        assert got == {k: seats[k] for k in range(23)}


# --- op10 ---
def plain_lines(rows):
    first, out = {}, {}
    kept = {}
    for i, t in sorted({(i, t) for i, t in rows if t is not None}):
        lines = t.split("\n")
        shown = [k for k, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c\n")]
        kept[i] = (lines, shown, set())
        for k in range(len(shown) - 2):
            key = tuple(lines[j].strip(" \t\r\x0b\x0c") for j in shown[k : k + 3])
            if key in first:
                kept[i][2].update(shown[k : k + 3])
            else:
                first[key] = (i, k)
    for i, (lines, _, gone) in kept.items():
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_lines(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows += [(9001, "a\nb\nc\nd"), (9002, "x\n b\nc\t\n\nd\ny"), (9003, "a\na\na\na\na"), (9004, "a\nb"), (9005, None), (9006, ""), (9007, "\n\n\n"), (9001, "a\nb\nc\nd")]
    df = spark.createDataFrame([(*r, 0, 1) for r in rows], "doc_id long, text string, at int, n_lines int")
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(df).collect()}
    assert got == plain_lines(rows) | {9005: None}
    assert line_dedup.deduplicated(df.limit(0)).count() == 0
    assert line_dedup.deduplicated(frame(spark, ODD, extra=True)).count() == len(ODD)


# --- pipeline ---
def test_pipeline(spark, sf_dir, docs):
    pipeline = importlib.import_module("corpus_pipeline")
    now = docs.unionByName(frame(spark, [(70_000, None, "a"), (70_001, "123 456", "a"), (70_002, "x y", None)]))
    texts = {}
    for name, stage in pipeline.STAGES:
        before = now.collect()
        now = spark.createDataFrame(stage(spark, now, sf_dir).collect(), stage(spark, now.limit(0), sf_dir).schema)
        after = now.collect()
        texts[name] = [(r["doc_id"], r["text"]) for r in after]
        if name != "sentencepiece":
            assert now.columns == docs.columns
        if name == "language_id":
            assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {70_000, 70_001}
        if name == "line_dedup":
            plain = plain_lines([(r["doc_id"], r["text"]) for r in before])
            old = {r["doc_id"]: r["text"] for r in before}
            assert dict(texts[name]) == {i: t for i, t in plain.items() if t == old[i] or WORD.search(t)}
        if name == "near_duplicates":
            groups, _ = plain_groups([(r["doc_id"], r["text"]) for r in before], 5)
            assert sorted(i for i, _ in texts[name]) == sorted(i for i, g in groups.items() if i == g)
        if name == "sentencepiece":
            assert all(r["ids"][-1] == 2 and r["n_tokens"] == len(r["ids"]) for r in after)
    assert pipeline.run(spark, sf_dir).count() > 0
