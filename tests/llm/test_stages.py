"""Pipeline stages and returned digests against plain readings: clashing names, nulls, repeats, empty tables."""

import hashlib
import importlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import language_id, quality_mcd, queries, sentencepiece_codec, source_mix, url_filter

CLASHES = ["score", "lang_pred", "_found", "n_removed", "n_lines", "_done", "_id", "_text_hash", "_at", "_times", "_copy", "_hash", "_seen", "_place", "_gone_id", "_gone_hash", "_key", "_source", "_size", "copies", "size", "a.b"]
LINES = "\n".join(f"the house number {i} of that street is old and grey" for i in range(6))
ROWS = [
    (1, "the cat sat on the mat and looked at the old dog of the house with all of its friends", "en", "a"),
    (2, "the cat sat on the mat and looked at the old dog of the house with all of its friends", "en", "b"),
    (2, "der Hund und die Katze sind in dem alten Haus und sehen den Garten mit den Kindern", "de", "b"),
    (3, LINES, "en", "a"), (4, "first words\n" + LINES + "\nlast words of it", "en", "a"), (4, "first words\n" + LINES + "\nlast words of it", "en", "a"),
    (5, None, None, None), (5, None, None, None), (6, "", "en", "a"), (7, "123 456", None, "c"), (None, "the null of all the ids is here", None, "c"), (8, "das ist der Garten und das Haus", None, "a"),
]


@pytest.fixture(scope="module")
def pipeline():
    return importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"<{c}>") for c in CLASHES})


def test_stages_pass_columns_of_any_name(spark, sf_dir, pipeline, odd):
    got = {}
    for name, stage in pipeline.STAGES:
        rows = stage(spark, odd, sf_dir).collect()
        got[name] = rows
        assert all(r[c] == f"<{c}>" for r in rows for c in CLASHES), name
        assert list(rows[0].asDict())[: len(odd.columns)] == odd.columns
    assert {r["doc_id"] for r in got["language_id"]} == {1, 2, 3, 4, 8, None} and all(r["lang"] for r in got["language_id"])
    text = {r["doc_id"]: r["text"] for r in got["line_dedup"] if r["doc_id"] == 4}
    assert text[4] == "first words\nlast words of it"
    # Judged by doc_id and text: of doc_id 2 only the copy of 1 goes, and 4 is a near copy of 3; of repeated rows one stays.
    near = sorted(((r["doc_id"] or 0, r["text"] or "") for r in got["near_duplicates"]))
    assert [i for i, _ in near] == [0, 1, 2, 3, 5, 6, 7, 8] and next(t for i, t in near if i == 2).startswith("der Hund")
    library = sentencepiece_codec.Codec(queries.tokenizer("piece_bpe_32k.model")).library
    assert len(got["sentencepiece"]) == len(ROWS)
    assert all(r["ids"] == library.encode(r["text"] or "") + [2] and r["n_tokens"] == len(r["ids"]) for r in got["sentencepiece"])


def test_stages_on_an_empty_table(spark, sf_dir, pipeline, odd):
    empty = odd.limit(0)
    for name, stage in pipeline.STAGES:
        out = stage(spark, empty, sf_dir)
        assert out.columns[: len(odd.columns)] == odd.columns and out.count() == 0, name


def test_last_stage_replaces_its_own_columns(spark, sf_dir, pipeline, odd):
    out = pipeline.token_stage(spark, odd.select("doc_id", "text").withColumns({"ids": F.lit("x"), "n_tokens": F.lit("y")}), sf_dir)
    assert sorted(out.columns) == ["doc_id", "ids", "n_tokens", "text"] and out.where("n_tokens < 1").count() == 0


def test_language_is_predicted_once(spark, sf_dir, pipeline):
    plan = pipeline.language_stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_mix_repeats_whole_documents(spark, sf_dir, pipeline):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r["doc_id"]: r["copies"] for r in source_mix.mixed(docs, copies=True).collect() if r["copies"]}
    got = {r["doc_id"]: r["count"] for r in pipeline.mix_stage(spark, docs, sf_dir).groupBy("doc_id").count().collect()}
    assert got == want


def test_digests_are_those_of_the_library(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, " ▁x  \n")], "doc_id long, text string"), True)
    model = queries.tokenizer("piece_bpe_32k.model")
    library, sha = sentencepiece_codec.Codec(model).library, lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in sentencepiece_codec.digests(docs, model).collect():
        ids = library.encode(texts[r["doc_id"]]) + [2]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def plain_prediction(model, text, cost):
    """By one word after the other: the best path, then the language with most letters."""
    words = language_id._WORDS(text or "")
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    s = model.scores(words).astype(np.float64)
    v, back = s[0].copy(), []
    for row in s[1:]:
        change = v.max() - cost
        back.append(np.where(v >= change, np.arange(len(v)), v.argmax()))
        v = np.maximum(v, change) + row
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    letters = np.array([sum(map(str.isalpha, w)) for w in words])
    per = np.bincount(path[::-1], letters, len(model.langs))
    silent = letters[s.max(axis=1) == s.min(axis=1)].sum() / letters.sum()
    return model.langs[int(per.argmax())], per.max() / letters.sum() * (1 - silent * (1 - 1 / len(model.langs)))


def test_predictions_equal_a_plain_path(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.learn(docs.select("doc_id", "text", "lang"))
    some = docs.collect()
    texts = [r["text"] for r in some] + [(a["text"] or "") + " " + (b["text"] or "") for a, b in zip(some, some[7:], strict=False)]
    for text, (lang, score) in zip(texts, language_id.Labeller(model).predict([t or "" for t in texts]), strict=True):
        want = plain_prediction(model, text, language_id.SWITCH_COST)
        assert score == pytest.approx(want[1], abs=0.02) and (lang == want[0] or score < 0.6)


def test_base_rules(spark):
    twenty, window = " ".join(f"w{i}" for i in range(20)), " ".join("abcdefgh")
    texts = [twenty, twenty.rsplit(" ", 1)[0], f"{window} {window} " + " ".join(f"v{i}" for i in range(38)), f"{window} {window} " + " ".join(f"v{i}" for i in range(37)), None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    got = {r["doc_id"]: r for r in quality_mcd.judged(df).collect()}
    assert [got[i]["base_failed"] for i in range(5)] == [False, True, False, True, True]
    assert [got[i]["n_repeat_words"] for i in range(4)] == [0, 0, 16, 16] and not any(got[i]["kept"] for i in (1, 3, 4))


def test_url_verdicts_beside_columns_of_any_name(spark):
    rows = [(1, "http://x.net/es/a", "f", "h", "d"), (1, "http://x.net/es/a", "f", "h", "d"), (2, None, "f", "h", "d")]
    pages = spark.createDataFrame(rows, "page_id long, url string, _found string, host string, `a.b` string")
    out = url_filter.judge(pages, queries.URL_RULES, replace=True)
    got = sorted((r["page_id"], r["_found"], r["host"], r["a.b"], r["rule"], r["verdict"]) for r in out.collect() if r["url"])
    assert got == [(1, "f", "x.net", "d", "net/es/", "block")] * 2
    assert out.where("url IS NULL").select("host", "rule", "verdict").collect() == [("", None, "allow")]
