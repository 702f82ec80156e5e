"""The queries of this subpackage: production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.llm import bm25_search, chat_format, language_id, line_dedup, quality_mcd, sentencepiece_codec, setsketch_dedup, source_mix, token_frames, url_filter
from sessionloom.llm._shared import documents

#: Fixed values of the queries.
URL_RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]
END_ID = 2


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mcd.judged(documents(spark, sf_dir))


def op3_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_frames.tokenised(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), END_ID)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), rules(rhost, rpath, rverdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), hits AS (
  SELECT page_id, url_rule, rverdict, row_number() OVER (PARTITION BY page_id ORDER BY length(url_rule) DESC, length(rhost) DESC) AS place FROM (
    SELECT p.page_id, rhost || rpath AS url_rule, rhost, rverdict FROM p JOIN rules
      ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) x
)
SELECT p.page_id, p.host, p.path, h.url_rule AS rule, coalesce(h.rverdict, 'allow') AS verdict
FROM p LEFT JOIN hits h ON h.page_id = p.page_id AND h.place = 1
"""


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table and conversation -7, whose texts are control strings."""
    odd = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(planted)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digests(chat_format.expand(conversations(spark, sf_dir)))


OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
         19 + length(regexp_replace(coalesce(role, ''), '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'))
            + length(regexp_replace(coalesce(text, ''), '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) + 1 AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
), r AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS so_far FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR k = n THEN so_far ELSE 0 END)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""


def op7_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return bm25_search.searched(docs, docs.where("doc_id % 20 = 0"))


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS term
  FROM documents WHERE text IS NOT NULL
), tf AS (
  SELECT doc_id, term, count(*) AS n FROM w GROUP BY ALL
), dl AS (
  SELECT d.doc_id, coalesce(sum(n), 0)::DOUBLE AS size FROM documents d LEFT JOIN tf USING (doc_id) WHERE d.text IS NOT NULL GROUP BY d.doc_id
), g AS (
  SELECT count(*)::DOUBLE AS docs, greatest(1, sum(size) / greatest(1, count(*))) AS mean_size FROM dl
), df AS (
  SELECT term, count(*) AS df FROM tf GROUP BY term
), q AS (
  SELECT doc_id AS query_id, term, n * ln(1 + (docs - df + 0.5) / (df + 0.5)) AS weight FROM tf JOIN df USING (term), g WHERE doc_id % 20 = 0
), p AS (
  SELECT doc_id, term, n * 2.2::DOUBLE / (n + 1.2::DOUBLE * (0.25 + 0.75 * size / mean_size)) AS impact FROM tf JOIN dl USING (doc_id), g
), s AS (
  SELECT query_id, doc_id, round(sum(weight * impact), 6) AS score FROM q JOIN p USING (term) GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0
)
SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch_dedup.grouped(documents(spark, sf_dir, "doc_id", "text"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicated(documents(spark, sf_dir, "doc_id", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL
), t AS (
  SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM l
), v AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM t WHERE length(line) > 0
), w AS (
  SELECT a.doc_id, a.k, md5(a.line || chr(10) || b.line || chr(10) || c.line) AS h
  FROM v a JOIN v b ON b.doc_id = a.doc_id AND b.k = a.k + 1 JOIN v c ON c.doc_id = a.doc_id AND c.k = a.k + 2
), r AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY h ORDER BY doc_id, k) AS place FROM w
), gone AS (
  SELECT DISTINCT v.doc_id, v.i FROM r JOIN v ON v.doc_id = r.doc_id AND v.k BETWEEN r.k AND r.k + 2 WHERE place > 1
), kept AS (
  SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text, count(g.i) AS n_removed
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce((SELECT count(*) FROM v WHERE v.doc_id = d.doc_id), 0)::BIGINT AS n_lines,
       coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(k.text) AS text_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality": op2_quality,
    "op3_token_frames": op3_token_frames,
    "op4_url_filter": op4_url_filter,
    "op5_language_id": op5_language_id,
    "op6_chat_format": op6_chat_format,
    "op7_bm25_search": op7_bm25_search,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_source_mix": op9_source_mix,
    "op10_line_dedup": op10_line_dedup,
}

ORACLES = {
    "op4_url_filter": OP4_SQL,
    "op6_chat_format": OP6_SQL,
    "op7_bm25_search": OP7_SQL,
    "op10_line_dedup": OP10_SQL,
}
