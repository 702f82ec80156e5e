"""Operator 9: mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Sizes are word counts. Targets share the total by weight, none above max_repeat times its source; the
   excess goes to the others by weight (solved at once by ordering sources by cap over weight).
2. Each source's documents are dealt to shards by a hash and laid end to end in hash order; a shard's
   line is cut into blocks of block_words words.
3. Highest quotients: sources get whole numbers of blocks with quotients target / (2k - 1); then each
   source's blocks go to its shards the same way. Sources at their cap take every block max_repeat times.
4. A shard with quota q of n blocks takes each block q div n times, and q mod n of them once more: those
   whose seeded permuted number (a * j + c) mod n is below q mod n.
5. A document takes the words of the blocks that it covers, so it may be taken in part.

All of it is DataFrame functions over documents and over one row per source or per (source, shard). Shards
follow the number of documents, not the cluster, so reruns agree, and a hot source is spread over all shards.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, ordered last;
a null doc_id counts as -1 in hashes; rows that share a doc_id and size are interchangeable; extra columns
are ignored; an empty table gives an empty result; if all sizes are 0, all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.llm._shared import columns_of, unused, written

BLOCK_WORDS = 16
DOCS_PER_SHARD = 8192
MAX_REPEAT = 3


def words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size -> with target and full (at its cap); one row per source.

    Weights are 1, 2, 3, repeating in code-point order, null last. In order of cap / weight, a prefix of
    the sources is at its cap and the others share what is left by weight.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    rows = sources.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    rows = rows.withColumn("cap", (max_repeat * F.col("source_size")).cast("double"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_rows = by_ratio.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    rows = rows.withColumns({
        "total": F.sum("source_size").over(all_rows).cast("double"),
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open_weight": F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    # The level at which this source and all after it would share; caps hold as long as cap / weight is below it.
    level = (F.col("total") - F.col("capped")) / F.col("open_weight")
    rows = rows.withColumn("level", level).withColumn("full", F.col("cap") / F.col("weight") <= F.col("level"))
    shared = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(all_rows)["level"]
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * shared)
    return rows.select("source", "source_size", target.alias("target"), "full")


def webster(cells: DataFrame, group: list[str], order: list[Column], weight: str, total: str) -> DataFrame:
    """cells with seats: the highest quotients weight / (2k - 1) in each group, as many as its total says.

    Rounding each quota to the nearest leaves d seats to give or take. A cell's part of d is at most its
    share of d plus one, so each cell offers only a window of quotients; all windows sum to O(cells).
    """
    g = W.partitionBy(*group)
    mass = F.sum(weight).over(g)
    quota = F.when(mass > 0, F.col(total) * F.col(weight) / mass).otherwise(0.0)
    c = cells.withColumn("_quota", quota).withColumn("_near", F.floor(F.col("_quota") + 0.5))
    off = F.abs(F.col(total) - F.sum("_near").over(g)) + F.count(F.lit(1)).over(g)
    reach = F.when(F.col(total) > 0, F.ceil(F.col("_quota") * off / F.col(total))).otherwise(0) + 1
    c = c.withColumn("_reach", reach).withColumn("_sure", F.greatest(F.lit(0), F.col("_near") - F.col("_reach")).cast("long"))
    c = c.withColumn("_left", (F.col(total) - F.sum("_sure").over(g)).cast("long"))
    offers = c.withColumn("_k", F.explode(F.sequence(F.lit(1), (2 * F.col("_reach") + 1).cast("int"))))
    offers = offers.withColumn("_quotient", F.col(weight) / (2 * (F.col("_sure") + F.col("_k")) - 1))
    place = F.row_number().over(g.orderBy(F.desc("_quotient"), *order, "_k"))
    won = F.sum(F.when((F.col("_place") <= F.col("_left")) & (F.col(weight) > 0), 1).otherwise(0))
    keys = cells.columns
    return offers.withColumn("_place", place).groupBy(*keys, "_sure").agg(won.alias("_won")).select(*keys, (F.col("_sure") + F.col("_won")).alias("seats"))


def _bits(seed: int, *columns: Column) -> Column:
    """A hash in 0 .. 2**31 - 1."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 31))


def mixed(
    docs: DataFrame, seed: int = 7, block_words: int = BLOCK_WORDS, max_repeat: int = MAX_REPEAT, copies: bool = False, keep_source: bool = False
) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document; with copies, also how often to take it whole.

    Whole copies follow taken / size; the fractions are rounded systematically in order of size in each
    shard of a source, so that the words of whole copies stay near the words taken.
    """
    slim = written(docs.select("doc_id", "source", words("text").alias("size")), "sizes")
    per_source = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs"))
    per_source = written(per_source, "sources")
    n_docs = per_source.agg(F.sum("_docs")).first()[0] or 0
    shards = max(1, -(-n_docs // DOCS_PER_SHARD))
    aimed = written(targets(per_source.select("source", "source_size"), max_repeat), "targets")

    b, ident = F.lit(block_words), F.coalesce(F.col("doc_id"), F.lit(-1))
    dealt = slim.withColumn("_shard", _bits(seed, ident) % shards)
    line = W.partitionBy("source", "_shard").orderBy(_bits(seed + 1, ident), "doc_id", "size")
    ends = F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0))
    dealt = dealt.withColumn("_to", ends).withColumn("_from", F.col("_to") - F.col("size"))

    cells = slim.groupBy("source", (_bits(seed, ident) % shards).alias("_shard")).agg(F.sum("size").alias("_len"))
    cells = cells.withColumn("_blocks", F.ceil(F.col("_len") / b))
    # Quotas of sources in blocks, then of a source's shards; sources at their cap need none.
    open_sources = aimed.where(~F.col("full") & (F.col("target") > 0)).select("source", "target")
    open_sources = open_sources.withColumn("_all", F.round(F.sum("target").over(W.partitionBy()) / b))
    seats = webster(open_sources, [], [F.col("source").asc_nulls_last()], "target", "_all").select("source", F.col("seats").alias("_seats"))
    same = lambda x, y: x["source"].eqNullSafe(y["source"])
    of_source = cells.join(seats, same(cells, seats), "inner").select(cells["source"], "_shard", "_len", "_blocks", "_seats")
    quotas = webster(of_source, ["source"], [F.col("_shard")], "_len", "_seats").select("source", "_shard", "_blocks", F.col("seats").alias("_quota"))
    quotas = written(quotas, "quotas").withColumns({"_times": F.floor(F.col("_quota") / F.col("_blocks")), "_more": F.col("_quota") % F.col("_blocks")})
    # An odd multiplier coprime to n: the first of a few seeded odd numbers that share no factor with n is
    # found by their greatest common divisors; n itself plus one always works.
    quotas = quotas.withColumn("_start", _bits(seed + 2, F.col("source"), F.col("_shard"))).withColumn("_step", _coprime(seed + 3))

    d = dealt.alias("d").join(aimed.alias("a"), F.col("d.source").eqNullSafe(F.col("a.source")), "left")
    d = d.join(quotas.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d._shard") == F.col("q._shard")), "left")
    # Words in extra blocks: over the blocks j that the document's words [_from, _to) touch.
    lo, hi = F.col("_from"), F.col("_to")
    j0, j1 = F.floor(lo / b), F.floor((hi - 1) / b)
    picked = lambda j: F.pmod(F.col("_step") * j + F.col("_start"), F.col("_blocks")) < F.col("_more")
    part = lambda j: F.least(hi, (j + 1) * b) - F.greatest(lo, j * b)
    extra = F.aggregate(F.sequence(j0, j1), F.lit(0).cast("long"), lambda acc, j: acc + F.when(picked(j), part(j)).otherwise(0))
    taken = (
        F.when(F.col("size") == 0, 0)
        .when(F.col("full"), max_repeat * F.col("size"))
        .when(F.col("_blocks").isNull(), 0)
        .otherwise(F.least(max_repeat * F.col("size"), F.col("_times") * F.col("size") + F.when(F.col("_more") > 0, extra).otherwise(0)))
    )
    out = d.select(F.col("d.doc_id"), F.col("d.source"), F.col("d._shard"), "size", "source_size", "target", taken.cast("long").alias("taken"))
    if copies:
        times = F.col("taken") / F.greatest(F.col("size"), F.lit(1))
        part, ident = times - F.floor(times), F.coalesce(F.col("doc_id"), F.lit(-1))
        run = F.sum("_part").over(W.partitionBy("source", "_shard").orderBy("size", _bits(seed + 20, ident), "doc_id").rowsBetween(W.unboundedPreceding, 0))
        draw = _bits(seed + 21, F.col("source"), F.col("_shard")) / float(1 << 31)
        out = out.withColumn("_part", F.round(part, 9)).withColumn("_run", run + draw)
        out = out.withColumn("copies", (F.floor(times) + F.floor("_run") - F.floor(F.col("_run") - F.col("_part"))).cast("int"))
    return out.select("doc_id", "size", "source_size", "target", "taken", *(["copies"] if copies else []), *(["source"] if keep_source else []))


def repeated(docs: DataFrame, seed: int = 7) -> DataFrame:
    """docs with each row as often as the mix takes it whole: 0 to MAX_REPEAT times.

    Rows are known by doc_id, source and size; of rows that share these, each is taken as often as the one taken
    most. Columns of any name pass through.
    """
    slim = docs.select("doc_id", "source", "text")
    taken = mixed(slim, seed, copies=True, keep_source=True).where("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies"))
    key, source, size, times, copy = unused(docs.columns, "_key", "_source", "_size", "_times", "_copy")
    taken = taken.select(F.col("doc_id").alias(key), F.col("source").alias(source), F.col("size").alias(size), F.col("copies").alias(times))
    same = F.col("doc_id").eqNullSafe(F.col(key)) & F.col("source").eqNullSafe(F.col(source)) & (words("text") == F.col(size))
    return docs.join(taken, same).withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(times)))).select(*columns_of(docs))


def _coprime(seed: int) -> Column:
    """A multiplier coprime to _blocks, from the seeded hash; 1 where eight tries fail."""
    def gcd(a: Column) -> Column:
        # Euclid in at most 45 steps, the most that numbers below 2**31 need.
        pair = F.aggregate(
            F.sequence(F.lit(1), F.lit(45)),
            F.struct(a.alias("x"), F.col("_blocks").cast("long").alias("y")),
            lambda p, _: F.when(p["y"] == 0, p).otherwise(F.struct(p["y"].alias("x"), F.pmod(p["x"], F.when(p["y"] == 0, 1).otherwise(p["y"])).alias("y"))),
        )
        return pair["x"]

    out = F.lit(1).cast("long")
    for k in reversed(range(8)):
        a = 2 * F.floor(_bits(seed + k, F.col("source"), F.col("_shard")) / 2) + 1
        out = F.when(gcd(a) == 1, a).otherwise(out)
    return out
