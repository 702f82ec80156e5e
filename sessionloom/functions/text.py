"""Text functions: Column -> Column, built-in functions only.

Patterns run with Unicode classes and boundaries. A null text counts as empty unless stated otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionloom.functions import vocab as V

_WHITE = r"[\s\x1C-\x1F]"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: str | Column) -> Column:
    return F.coalesce(_c(c), F.lit(""))


def has(c: str | Column, pattern: str) -> Column:
    return text(c).rlike(f"(?iU){pattern}")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def strip(c: str | Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text(c), rf"(?U)^{_WHITE}+|{_WHITE}+\z", "")


def word_count(c: str | Column) -> Column:
    s = strip(c)
    return F.when(F.length(s) == 0, 0).otherwise(F.size(F.split(s, rf"(?U){_WHITE}+")))


def normalise_newlines(c: str | Column) -> Column:
    return strip(F.regexp_replace(strip(F.regexp_replace(text(c), "\r\n?", "\n")), "\n{3,}", "\n\n"))


def sanitize(c: str | Column) -> Column:
    """Markup, byte-order marks and separator lines removed; runs of blank lines collapsed; stripped."""
    t = F.replace(F.regexp_replace(text(c), "\r\n?", "\n"), F.lit("﻿"), F.lit(""))
    for pattern in (V.HTML_COMMENT, V.THINK_BLOCK, V.TOOL_BLOCK, V.COMMAND_TAG):
        t = F.regexp_replace(t, pattern, "")
    lines = F.filter(F.split(t, r"\R|[\x1C-\x1E]", -1), lambda x: ~strip(x).isin(V.SEPARATORS))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def summarize_tools(c: str | Column) -> Column:
    """Each tool block becomes [tool: its name], or [tool: tool]."""
    inside = r"(?:(?!</tool-use>)[\s\S])*?"
    named = F.regexp_replace(text(c), rf'(?i)<tool-use\b(?={inside}data-tool-name="([^"]*)"){inside}</tool-use>', "[tool: $1]")
    return F.regexp_replace(named, V.TOOL_BLOCK, "[tool: tool]")


def has_tool_block(c: str | Column) -> Column:
    return text(c).rlike(V.TOOL_BLOCK)


def speaker_role(line: str | Column) -> Column:
    """The role word of a speaker line in lower case, else null."""
    found = [F.nullif(F.regexp_extract(text(line), f"(?iU){p}", 1), F.lit("")) for p in V.SPEAKERS]
    return F.lower(F.coalesce(*found))


def inline_after_role(line: str | Column) -> Column:
    return strip(F.regexp_extract(text(line), f"(?iU){V.ROLE_COLON}", 2))


def speaker_model(line: str | Column) -> Column:
    return strip(F.regexp_extract(text(line), r"\(([^)]+)\)", 1))


def code_blocks(c: str | Column) -> Column:
    """array<struct<lang, code>> of the fences that hold code."""
    t = text(c)
    pairs = F.arrays_zip(
        F.regexp_extract_all(t, F.lit(V.CODE_FENCE), F.lit(1)).alias("lang"), F.regexp_extract_all(t, F.lit(V.CODE_FENCE), F.lit(2)).alias("code")
    )
    named = F.transform(pairs, lambda x: F.struct(F.coalesce(F.nullif(F.lower(x["lang"]), F.lit("")), F.lit("unknown")).alias("lang"), strip(x["code"]).alias("code")))
    return F.filter(named, lambda x: F.length(x["code"]) > 0)


def is_acknowledgment(c: str | Column) -> Column:
    """Nothing topical is left without one leading interjection and trailing filler."""
    core = F.regexp_replace(F.regexp_replace(text(c), f"(?iU){V.ACK_LEAD}", ""), f"(?iU){V.ACK_TRAIL}", "")
    return strip(core).rlike(f"(?iU){V.ACK_CORE}")


def is_ide_dump(c: str | Column) -> Column:
    s = strip(c)
    return s.startswith("[{") & (sum(s.contains(m).cast("int") for m in V.IDE_MARKERS) >= 3)


def is_path_heavy(c: str | Column) -> Column:
    s = strip(c)
    return has(s, V.PATH_START) & (F.length(strip(F.regexp_replace(s, f"(?iU){V.PATHS}", " "))) < 12)


def has_cjk(c: str | Column) -> Column:
    return text(c).rlike(V.CJK)


def count_han(c: str | Column) -> Column:
    return F.regexp_count(text(c), F.lit(V.HAN))


@dataclass(frozen=True)
class CleaningConfig:
    min_chars: int = 25
    min_words: int = 4
    min_chars_cjk: int = 18
    min_cjk_chars: int = 8
    max_chars: int = 8000
    drop_noise_patterns: bool = True
    drop_acknowledgments: bool = True
    drop_duplicates: bool = True
    dedupe_columns: tuple[str, ...] = ("prompt_text",)
    max_prompts_per_repo: int | None = None
    repo_column: str = "full_name"
    seed: int = 42


def noise_reason(c: str | Column, config: CleaningConfig | None = None) -> Column:
    """The first reason to drop a prompt, else null."""
    config = config or CleaningConfig()
    return bound(strip(c), lambda s: _noise_reason(s, config))


def _noise_reason(s: Column, config: CleaningConfig) -> Column:
    out = F.when(F.length(s) == 0, "empty")
    if config.drop_acknowledgments:
        out = out.when(is_acknowledgment(s), "acknowledgment")
    out = out.when(is_ide_dump(s), "ide_diagnostic_dump").when(is_path_heavy(s), "path_only_prompt")
    if config.drop_noise_patterns:
        for reason, pattern in V.NOISE:
            out = out.when(has(s, pattern), reason)
    short_cjk = (F.length(s) < config.min_chars_cjk) | (count_han(s) < config.min_cjk_chars)
    short = (F.length(s) < config.min_chars) | (word_count(s) < config.min_words)
    return out.when(F.length(s) > config.max_chars, "too_long").when(has_cjk(s) & short_cjk, "too_short").when(~has_cjk(s) & short, "too_short")


def linguistics(c: str | Column) -> dict[str, Column]:
    t = text(c)
    return {
        "char_len": F.length(t),
        "word_len": word_count(t),
        "line_count": F.regexp_count(t, F.lit("\n")) + 1,
        "has_question": t.contains("?"),
        "has_code_mention": has(t, V.CODE_MENTION),
        "starts_imperative": has(t, V.IMPERATIVE_START),
    }


def intents(c: str | Column) -> dict[str, Column]:
    """intent_<name> flags, intent_count and primary_intent."""
    flags = {k: has(c, p) for k, p in V.INTENTS.items()}
    first = F.coalesce(*[F.when(f, k) for k, f in flags.items()], F.lit("unclassified"))
    return {f"intent_{k}": f for k, f in flags.items()} | {"intent_count": sum(f.cast("int") for f in flags.values()), "primary_intent": first}


def prompt_type(c: str | Column) -> Column:
    t = F.lower(strip(c))
    counts = F.array(*[F.regexp_count(t, F.lit(f"(?iU){p}")) for p in V.PROMPT_TYPES.values()])

    def kind(n: Column) -> Column:
        most = F.array_max(n)
        out = F.when(n[list(V.PROMPT_TYPES).index("question")] > 0, "question")
        for i, k in enumerate(V.PROMPT_TYPES):
            out = out.when((n[i] == most) & (most > 0), k)
        return out.otherwise("other")

    return bound(counts, kind)


def _flag(c: str | Column) -> Column:
    return F.coalesce(_c(c), F.lit(False))


def action_label(prompt: str | Column, response: str | Column, has_code: str | Column, has_tool: str | Column, blocks: str | Column, code: str | Column) -> Column:
    """What the agent did on a turn; null flags count as false and null texts as empty."""
    debug, implement, review = (has(prompt, p) for p in (V.DEBUG, V.IMPLEMENT, V.REVIEW))
    explain = has(prompt, V.EXPLAIN) | text(prompt).contains("?")
    code_on, tool, n = _flag(has_code), _flag(has_tool), F.coalesce(_c(blocks), F.lit(0))
    code_chars = F.length(strip(code))
    body = strip(response)
    chars = F.when(body == "nan", 0).otherwise(F.length(body))
    one = code_on & (n == 1)
    return (
        F.when(tool & (n == 0), "tool_only")
        .when(code_on & ((n >= V.SUBSTANTIAL_CODE_BLOCKS) | (code_chars >= V.SUBSTANTIAL_CODE_CHARS)), "implement")
        .when(one & debug, "debug")
        .when(one & explain & ~implement, "explain")
        .when(one & implement, "implement")
        .when(one, F.when(code_chars < V.SHORT_SNIPPET_CHARS, "explain").otherwise("implement"))
        .when(debug, F.when(chars > V.LONG_DEBUG_CHARS, "debug").otherwise("explain"))
        .when(explain, "explain")
        .when(review | implement, "review")
        .when(tool, "tool_only")
        .when((chars < V.SHORT_RESPONSE_CHARS) & ~code_on, "other")
        .when(chars > 0, "explain")
        .otherwise("other")
    )


def prompt_rule(c: str | Column) -> Column:
    return (
        F.when(has(c, V.DEBUG), "debug").when(has(c, V.IMPLEMENT), "implement").when(has(c, V.REVIEW), "review")
        .when(has(c, V.EXPLAIN) | text(c).contains("?"), "explain").otherwise("other")
    )


def keyword_code(c: str | Column) -> Column:
    """1 or 0, null where no word decides."""
    return F.when(has(c, V.CODE_WORDS), 1).when(has(c, V.NO_CODE_WORDS), 0)


def keyword_tool(c: str | Column) -> Column:
    return F.when(has(c, V.TOOL_WORDS), 1)


def mask_keywords(c: str | Column) -> Column:
    """No keyword occurs in the mask, so one alternation equals the words one after the other."""
    return F.regexp_replace(text(c), rf"(?iU)\b(?:{'|'.join(V.MASKED)})\b", V.MASK)


def audit_flags(c: str | Column) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(has(c, p), k) for k, p in V.AUDIT_FLAGS.items()])), ",")


def audit_category(c: str | Column, has_code: str | Column) -> Column:
    return (
        F.when(_flag(has_code) & (F.length(audit_flags(c)) > 0), "code_despite_non_implementation_prompt")
        .when(~_flag(has_code) & has(c, V.AUDIT_VERBS), "no_code_despite_implementation_prompt")
        .otherwise("consistent")
    )


def code_to_text_ratio(code: str | Column, response: str | Column) -> Column:
    n, d = F.length(text(code)), F.length(text(response))
    return F.when(d > 0, n / d).otherwise(0.0)


def ascii_share(c: str | Column) -> Column:
    s = strip(c)
    return F.when(F.length(s) > 0, F.regexp_count(s, F.lit(r"[\x00-\x7F]")) / F.length(s)).otherwise(1.0)


def needs_translation(c: str | Column, detector: Column | None = None) -> Column:
    """CJK, or under 85 % ASCII; detector (a boolean column over the first 800 characters) decides the rest."""
    s = strip(c)
    rest = F.coalesce(detector, F.lit(False)) if detector is not None else F.lit(False)
    return F.when((F.length(s) < 2) | (F.lower(s) == "nan"), False).when(has_cjk(s), True).when(ascii_share(s) < 0.85, True).otherwise(rest)


def chunks(c: str | Column, most: int = 3500) -> Column:
    """Paragraphs and their separators packed greedily into bins of at most most characters; a longer one stays whole."""
    t = text(c)
    parts = F.regexp_extract_all(t, F.lit(r"(?s)\n\n+|(?:(?!\n\n).)+"), F.lit(0))
    packed = F.aggregate(
        parts,
        F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now")),
        lambda a, x: F.when(
            (F.length(a["now"]) + F.length(x) > most) & (F.length(a["now"]) > 0),
            F.struct(F.concat(a["done"], F.array(a["now"])).alias("done"), x.alias("now")),
        ).otherwise(F.struct(a["done"].alias("done"), F.concat(a["now"], x).alias("now"))),
        lambda a: F.when(F.length(a["now"]) > 0, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]),
    )
    return F.when(F.length(t) <= most, F.array(t)).otherwise(packed)


def preview(c: str | Column, most: int = 30_000) -> Column:
    suffix = "\n...[truncated]"
    t = text(c)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 20), F.lit(suffix))).otherwise(t)


def truncate(c: str | Column, most: int) -> Column:
    t = text(c)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.format_string("...[truncated, %d chars total]", F.length(t)))).otherwise(t)


def blob_id(columns: list[str], value: str) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*columns, value]])), 1, 16)


def text_hash(c: str | Column) -> Column:
    return F.sha2(text(c), 256)


def row_hash(version: str, prompt: str | Column, response: str | Column) -> Column:
    return F.sha2(F.concat_ws("||", F.lit(version), text(prompt), text(response)), 256)


def session_id(repo: str = "full_name", file: str = "source_file") -> Column:
    return F.concat(text(F.col(repo).cast("string")), F.lit("|"), text(F.col(file).cast("string")))


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


def commit_flag(message: str | Column) -> Column:
    low = F.lower(text(message))
    return any_of([low.contains(w) for w in V.COMMIT_WORDS])


def parse_label(raw: str | Column) -> Column:
    """struct<action_type, confidence, rationale, error> of a model's JSON reply."""
    body = F.regexp_extract(text(raw), r"(?s)\{.*\}", 0)
    p = F.from_json(body, "action_type string, confidence string, rationale string, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    kind = F.lower(strip(p["action_type"]))
    error = (
        F.when(F.length(body) == 0, "no_json_found").when(p["_corrupt"].isNotNull(), "json_error")
        .when(p["action_type"].isNull(), "missing_action_type_key").when(~kind.isin(V.ACTIONS), F.concat(F.lit("invalid_action_type:"), kind))
    )
    ok = error.isNull()
    return F.struct(
        F.when(ok, kind).otherwise("other").alias("action_type"),
        F.when(ok, F.coalesce(p["confidence"].try_cast("double"), F.lit(0.0))).otherwise(0.0).alias("confidence"),
        F.when(ok, F.substring(F.coalesce(p["rationale"], F.lit("")), 1, 300)).otherwise("").alias("rationale"),
        error.alias("error"),
    )
