"""Operator 10: overlapping three-line windows, with DataFrame functions only.

A line is what stands between line feeds; it takes part if it has a visible character once trimmed of
white space. Every run of three such lines of a document is a window, known by two 64-bit hashes of its
trimmed lines, which 1e12 windows share by chance with a probability below 1e-14. Windows found more than once anywhere keep their first occurrence (smallest doc_id, then
text hash, then position); all later ones are removed by merging the lines that they cover.

Only hashes and positions are shuffled for the search: first occurrences come from an aggregation that
combines before the shuffle, and the join back to occurrences has at most one row a hash on one side, so
a passage that a third of the documents share can be split over tasks.

Defined results: a document is known by (doc_id, hash of its text), so rows repeated exactly count as one
document and are treated alike; a null text stays null; documents of fewer than three lines that take
part are left alone; lines without visible characters stay where they are; lines that repeat inside one
document are later occurrences too; other columns pass through, whatever their names; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm._shared import columns_of, unused, written

SIZE = 3


def lines(text: str | Column) -> Column:
    return F.split(text, "\n", -1)


def _trimmed(line: Column) -> Column:
    """Without ASCII white space at either end."""
    return F.btrim(line, F.lit(" \t\r\x0b\x0c"))


def windows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """_id, _text_hash, at (position among lines that take part), hash: one row for each window."""
    kept = F.filter(F.transform(lines("text"), _trimmed), lambda x: F.length(x) > 0)
    # Two hashes of a line from different starts; a window is known by both hashes of its lines.
    pair = lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(0x5EED), x).alias("b"))
    hashed = docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text_hash"), F.transform(kept, pair).alias("_h")
    )
    of = lambda k, name: F.xxhash64(*[F.element_at("_h", (k + j).cast("int"))[name] for j in range(size)])
    runs = F.transform(F.sequence(F.lit(1), F.size("_h") - (size - 1)), lambda k: F.struct(of(k, "a").alias("a"), of(k, "b").alias("b")))
    return hashed.where(F.size("_h") >= size).select("_id", "_text_hash", F.posexplode(runs).alias("at", "hash"))


def later_occurrences(found: DataFrame) -> DataFrame:
    """_id, _text_hash, at: windows whose hash has an earlier occurrence."""
    place = F.struct(F.coalesce(F.col("_id"), F.lit(-(1 << 63))).alias("a"), F.col("_text_hash").alias("b"), F.col("at").alias("c"))
    ends = found.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = ends.where(F.col("first") < F.col("last")).select("hash", "first")
    return found.join(repeated, "hash").where(place > F.col("first")).select("_id", "_text_hash", "at")


def deduplicated(docs: DataFrame, size: int = SIZE, counts: bool | tuple[str, str] = False) -> DataFrame:
    """docs with text without later occurrences; with counts also n_lines and n_removed (lines that take part).

    counts may name these two columns; columns of docs with their names are replaced.
    """
    found = written(windows(docs.select("doc_id", "text"), size), "windows")
    later = later_occurrences(found).groupBy("_id", "_text_hash").agg(F.collect_set("at").alias("_at"))
    both = docs.alias("d").join(
        later.alias("l"), F.col("d.doc_id").eqNullSafe(F.col("l._id")) & (F.xxhash64("d.text") == F.col("l._text_hash")), "left"
    )
    # Bound once as a lambda variable: the lines, and where those that take part stand among all lines.
    parts = F.struct(lines("d.text").alias("all"), F.coalesce("l._at", F.array().cast("array<int>")).alias("at"))
    shown = lambda x: F.filter(F.sequence(F.lit(0), F.size(x["all"]) - 1), lambda i: F.length(_trimmed(F.get(x["all"], i))) > 0)
    placed = F.transform(F.array(parts), lambda x: F.struct(x["all"].alias("all"), x["at"].alias("at"), shown(x).alias("shown")))
    covered = lambda x: F.flatten(F.transform(x["at"], lambda a: F.slice(x["shown"], a + 1, size)))
    merged = F.transform(
        placed,
        lambda x: F.struct(
            x["all"].alias("all"), F.size(x["shown"]).alias("n"), F.array_except(F.sequence(F.lit(0), F.size(x["all"]) - 1), covered(x)).alias("left")
        ),
    )
    done = F.transform(
        merged,
        lambda x: F.struct(
            F.array_join(F.transform(x["left"], lambda i: F.get(x["all"], i)), "\n").alias("text"),
            x["n"].cast("long").alias("n_lines"),
            (F.size(x["all"]) - F.size(x["left"])).cast("long").alias("n_removed"),
        ),
    )
    plain = F.col("d.text").isNull()
    names = ("n_lines", "n_removed") if counts is True else counts or ()
    (made,) = unused([*docs.columns, *names, "_id", "_text_hash", "_at"], "_done")
    every = both.withColumn(made, F.when(~plain, F.get(done, F.lit(0))))
    out = [F.col(f"{made}.text").alias("text") if c == "text" else columns_of(docs, [c], "d")[0] for c in docs.columns if c not in names]
    more = [F.coalesce(F.col(f"{made}.{c}"), F.lit(0)).alias(name) for c, name in zip(("n_lines", "n_removed"), names, strict=False)]
    return every.select(*out, *more)
