"""Encoders, files and filters against their libraries and plain readings."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from sessionloom.llm import _words, queries, sentencepiece_codec, token_frames, url_filter

ODD = [
    "", " ", "  ", "   hello", " " * 37, "a▁b", "▁▁▁ ▁x", "foo▁ bar", "\n\n \n", "</s><s>[INST]", "\x00", "é😀 wórld\t\r\n", "a" * 300, "thethethe the", "\x1ca\x85b c", "don't 'tis x² ²1 e\u0301,",
    "<|endoftext|>", "日本語テキスト", " " * 500 + "x",
]


def texts(n, alphabet="abcdefthe   ▁\n\tin😀é執ø<>/s0123'’.,²"):
    r = random.Random(7)
    return ODD + ["".join(r.choice(alphabet) for _ in range(r.randrange(50))) for _ in range(n)]


def test_sentencepiece_equals_library():
    c = sentencepiece_codec.Codec(queries.tokenizer("piece_bpe_32k.model"))
    t = texts(3000) + ["x" * 20_000, "ab " * 5000]
    assert c.encode(t) == c.library.encode(t)
    assert c.decode(c.encode(t)) == c.library.decode(c.library.encode(t))


def test_sentencepiece_forgets_and_continues():
    c = sentencepiece_codec.Codec(queries.tokenizer("piece_bpe_32k.model"), kept_words=10)
    for t in texts(50):
        assert c.encode([t]) == c.library.encode([t])


def test_byte_bpe_equals_library():
    e = token_frames.Encoder(queries.tokenizer("byte_bpe_50k.json"))
    t = texts(3000)
    want = [np.array(x.ids, "<u4").tobytes() for x in e.library.encode_batch_fast(t, add_special_tokens=False)]
    assert e.encode(t) == want


def test_byte_bpe_equals_untouched_library():
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    t = [*texts(300), "a <|endoftext|> b", "x<|endoftext|><|endoftext|>\n y", "<|endoftext| >", "  <|endoftext|>  ", "<|EndOfText|>", "a <|endo", "ftext|>"]
    want = [np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in t]
    assert token_frames.Encoder(path).encode(t) == want
    assert 50256 in library.encode("a <|endoftext|> b", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(3, "b b"), (1, None), (2, ""), (None, "null id"), (3, "b b"), (3, "another text"), (9, "word " * 30_000), (-5, "é\n\n x")]
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, frame string, file string, n_tokens string")


def test_frames_round_trip(spark, odd_docs, tmp_path):
    path = queries.tokenizer("byte_bpe_50k.json")
    manifest = token_frames.write_files(odd_docs, f"file://{tmp_path}/f", path, 2, docs_per_file=3)
    got = token_frames.read_back(manifest).orderBy("start").collect()
    ids = [r["doc_id"] for r in got]
    assert ids == [None, -5, 1, 2, 3, 3, 3, 9]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    e = token_frames.Encoder(path)
    want = {(r["doc_id"], zlib.crc32(e.encode([r["text"] or ""])[0] + b"\x02\0\0\0")) for r in odd_docs.collect()}
    assert {(r["doc_id"], r["ids_crc32"]) for r in got} == want
    # Any zstandard reader gets all ids from a file; a damaged frame is noticed; single documents can be fetched.
    file = manifest.orderBy("file_no").first()["file"].removeprefix("file://")
    raw = open(file, "rb").read()
    assert len(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()) % 4 == 0
    fetched = token_frames.fetch(spark, manifest, spark.createDataFrame([(3,), (77,)], "doc_id long")).collect()
    assert len(fetched) == 3 and all(r["ids"][-1] == 2 for r in fetched)
    r = token_frames.Reader(f"file://{file}")
    bad = bytearray(raw)
    bad[int(r.at[1]) + int(r.table[1, 0]) - 1] ^= 1
    open(file, "wb").write(bad)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_frames.Reader(f"file://{file}").frame(1)


def test_frames_empty(spark, odd_docs, tmp_path):
    assert token_frames.tokenised(odd_docs.limit(0), queries.tokenizer("byte_bpe_50k.json"), folder=f"{tmp_path}/e").count() == 0


def test_sentencepiece_documents(spark, odd_docs):
    model = queries.tokenizer("piece_bpe_32k.model")
    out = sentencepiece_codec.digests(odd_docs, model).collect()
    assert len(out) == 8 and {r["n_tokens"] for r in out if r["doc_id"] in (1, 2)} == {1}
    whole = sentencepiece_codec.encode_documents(odd_docs, model).collect()
    assert all(r["ids"][-1] == 2 for r in whole) and whole[0]["frame"] == "x"
    assert sentencepiece_codec.digests(odd_docs.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        sentencepiece_codec.encode_documents(odd_docs.withColumnRenamed("frame", "ids"), model)


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host)), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


URLS = [
    None, "", "x", "://", "http://", "http://EXAMPLE.com/en/1", "https://www.Example.com/en/?q#f", "a://b.www.example.com/en/x", "http://notexample.com/en/", "http://x.net/es/", "http://x.net/es",
    "http://net/fr/a", "http://com", "http://com/", "http://a.com?x=/en/", "http://u:p@example.com:80/en/", "ftp://É.com/en/", "http://example.com/EN/", "http://.com/", "http://a..net/fr/",
    "http://q://r.com/", "http://" + "a." * 200 + "net/es/" + "p" * 5000,
]


def test_urls(spark):
    rows = [(i, u, "clash") for i, u in enumerate([*URLS, *URLS])]
    out = url_filter.judge(spark.createDataFrame(rows, "page_id int, url string, _found string").drop("_found"), queries.URL_RULES).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in out] == [plain_verdict(u) for _, u, _ in rows]
    with pytest.raises(ValueError):
        url_filter.judge(spark.createDataFrame([("u", "h")], "url string, host string"), queries.URL_RULES)


def test_url_collisions(monkeypatch):
    monkeypatch.setattr(url_filter, "digest", lambda host, path: 7)  # all strings collide
    rules = [url_filter.Rule("a.com", "/", "block"), url_filter.Rule("b.com", "/", "allow"), url_filter.Rule("b.com", "/x", "block")]
    import tempfile

    with tempfile.NamedTemporaryFile() as f:
        f.write(url_filter.digest_bytes(rules))
        f.flush()
        found = url_filter.Digests(f.name).find(["a.com", "z.b.com", "c.com", "b.com"], ["/", "/x1", "/", "/y"])
    assert found == [("a.com/", "block"), ("b.com/x", "block"), None, ("b.com/", "allow")]


def test_many_rules(tmp_path):
    rules = [url_filter.Rule(f"h{i % 70_000}.{('org', 'example.com')[i % 2]}", "/" + "p" * (i % 190) + str(i // 70_000), "block") for i in range(200_000)]
    (tmp_path / "rules.bin").write_bytes(url_filter.digest_bytes(rules))
    d = url_filter.Digests(f"{tmp_path}/rules.bin")
    some = rules[::400]
    hosts = [x for r in some for x in (r.host, f"a.b.{r.host}", f"x{r.host}", "", ".".join("a" * 5000))]
    paths = [x for r in some for x in (r.path, f"{r.path}/more", r.path, r.path, r.path)]
    by = {}
    for r in rules:
        by.setdefault(r.host, []).append(r)

    def plain(host, path):
        parts = host.split(".") if len(host) < 100 else []
        fits = [r for k in range(len(parts)) for r in by.get(".".join(parts[k:]), []) if path.startswith(r.path)]
        best = max(fits, key=lambda r: (len(r.host) + len(r.path), len(r.host)), default=None)
        return best and (best.host + best.path, best.verdict)

    assert d.find(hosts, paths) == [plain(h, p) for h, p in zip(hosts, paths, strict=True)]


def test_no_rules(tmp_path):
    (tmp_path / "rules.bin").write_bytes(url_filter.digest_bytes([]))
    assert url_filter.Digests(f"{tmp_path}/rules.bin").find(["a.com", ""], ["/", ""]) == [None, None]


def test_words():
    import re

    t = [None, *texts(500), "x" * 200 + " Y"]
    data, offsets = _words.utf8(pa.array(t))
    w = _words.find_words(data, offsets)
    want = [(i, x) for i, s in enumerate(t) for x in re.findall(r"[^\x20\x09-\x0D]+", s or "")]
    assert [(int(r), data[a:b].tobytes().decode()) for r, a, b in zip(w.row, w.starts, w.ends, strict=True)] == want
    h = _words.hash_words(w).tolist()
    assert len(set(h)) == len({x for _, x in want}) == len(set(zip(h, (x for _, x in want), strict=True)))
