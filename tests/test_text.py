"""Text rules on inline cases, each with the result that the rule gives."""

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import text as T


def values(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", column.alias("v")).orderBy("i").collect()
    return [r["v"] for r in rows]


NOISE = {
    "": "empty", "ok": "acknowledgment", "thanks": "acknowledgment", "Ok, continue.": "acknowledgment", "Sounds good, go ahead!": "acknowledgment",
    "Ok, use PyQt6 and continue.": None, "note": "too_short", "./src/app.tsx": "path_only_prompt",
    "/home/u/app.py please fix the failing import in this module": None, "/fix now": "slash_command", "[request interrupted by user]": "request_interrupted",
    "see ::error:: build failed in step four": "ci_runner_log", "word " * 1601: "too_long", "Fix the bug": "too_short", "請修復這個錯誤": "too_short",
    "请帮我修复登录页面上的错误提示信息谢谢您": None, "  \n ": "empty",
    '[{"resource": 1, "owner": 2, "severity": 3}]': "ide_diagnostic_dump", "@agent x: \"do it now please\"": "agent_action_artifact",
}


def test_noise(spark):
    assert values(spark, list(NOISE), T.noise_reason("t")) == list(NOISE.values())
    assert values(spark, [None], T.noise_reason("t")) == ["empty"]


def test_strip_and_words(spark):
    texts = ["", None, " a  b\n", " x y ", "one", "\x1ca\x1d"]
    assert values(spark, texts, T.strip("t")) == ["", "", "a  b", "x y", "one", "a"]
    assert values(spark, texts, T.word_count("t")) == [0, 0, 2, 2, 1, 1]


def test_sanitize(spark):
    text = "﻿<!-- c\nd -->a\r\n---\r\n<think>x\ny</think>b<tool-use q>z</tool-use>\n\n\n\n<command-name>/x</command-name> c\n***\n"
    assert values(spark, [text, None, "---"], T.sanitize("t")) == ["a\nb\n\n/x c", "", ""]


def test_intents(spark):
    t = ["Add unit tests for the login component", "Fix the SQL migration", "hello"]
    x = T.intents("t")
    assert values(spark, t, x["primary_intent"]) == ["implement", "debug_fix", "unclassified"]
    assert values(spark, t, x["intent_count"]) == [2, 2, 0]
    assert values(spark, t, x["intent_test"]) == [False, False, False]


def test_prompt_type(spark):
    t = ["add a test", "What is it?", "fix the bug in crash", "it should return or raise", "hello there", "", None]
    assert values(spark, t, T.prompt_type("t")) == ["imperative", "question", "debug", "specification", "other", "other", "other"]


ACTIONS = [
    # prompt, response, code?, tool?, blocks, code, label
    ("x", "", False, True, 0, "", "tool_only"), ("x", "", True, False, 2, "", "implement"), ("x", "", True, False, 1, "c" * 350, "implement"),
    ("Why does this crash?", "", True, False, 1, "c" * 50, "debug"), ("What is this?", "", True, False, 1, "c" * 50, "explain"),
    ("How do I add X", "", True, False, 1, "c" * 50, "implement"), ("hello there", "", True, False, 1, "c" * 50, "explain"), ("hello there", "", True, False, 1, "c" * 200, "implement"),
    ("the build failed", "r" * 100, False, False, 0, "", "debug"), ("the build failed", "r" * 10, False, False, 0, "", "explain"), ("Please add a button", "r", False, False, 0, "", "review"),
    ("hello", "", False, False, 0, "", "other"), ("hello", "r" * 10, False, False, 0, "", "other"), ("hello", "r" * 50, False, False, 0, "", "explain"),
    ("hello", "", False, True, 1, "", "tool_only"), ("hello", "nan", False, False, 0, "", "other"), (None, None, None, None, None, None, "other"),
]


@pytest.mark.parametrize("case", ACTIONS, ids=range(len(ACTIONS)))
def test_action(spark, case):
    df = spark.createDataFrame([case[:6]], "p string, r string, c boolean, t boolean, b int, g string")
    assert df.select(T.action_label("p", "r", "c", "t", "b", "g")).first()[0] == case[6]


def test_keywords_and_mask(spark):
    t = ["why write this", "Explain the error", "hello"]
    assert values(spark, t, T.keyword_code("t")) == [1, 0, None]
    assert values(spark, ["Fix the bug in my class API", "bugé debugging"], T.mask_keywords("t")) == ["[MASK] the [MASK] in my [MASK] [MASK]", "bugé debugging"]


def test_json_labels(spark):
    t = ["{}", "no json", '{"action_type":"fly"}', '{"action_type":"DEBUG"}', '{"action_type": "review", "confidence": "x"}', "{broken"]
    rows = values(spark, t, T.parse_label("t"))
    assert [r["error"] for r in rows] == ["missing_action_type_key", "no_json_found", "invalid_action_type:fly", None, None, "no_json_found"]
    assert [r["action_type"] for r in rows][3:5] == ["debug", "review"] and rows[4]["confidence"] == 0.0
    assert values(spark, ["{broken}"], T.parse_label("t"))[0]["error"] == "json_error"


def test_preview_and_chunks(spark):
    assert values(spark, ["a" * 30_001], F.length(T.preview("t")))[0] == 29_980 + len("\n...[truncated]")
    text = "aaaa\n\nbbbb\n\n\ncccc"
    (chunks,) = values(spark, [text], T.chunks("t", 8))
    assert "".join(chunks) == text and all(len(c) <= 8 for c in chunks)
    assert values(spark, ["short"], T.chunks("t", 8)) == [["short"]]


def test_code_blocks_and_tools(spark):
    t = "a\n```Py x\nx = 1\n```\n```\n\n```\n```\ny\n```"
    (b,) = values(spark, [t], T.code_blocks("t"))
    assert [(x["lang"], x["code"]) for x in b] == [("py", "x = 1"), ("unknown", "y")]
    tools = '<tool-use>a</tool-use><TOOL-USE data-tool-name="Edit">b\nc</TOOL-USE>'
    assert values(spark, [tools], T.summarize_tools("t")) == ["[tool: tool][tool: Edit]"]
