"""Calls of a model, with clients that answer from a table."""

import json
import os

import pytest
from pyspark.sql import functions as F

from feedloom.operators import language, model

PROMPT = "---\nversion: 3\n---\nShared rules.\n- Language: any\n\n## Band: regular\nPosts.\n\n## Band: recap\nThemes.\n"


def reply(n):
    return json.dumps({"items": [{"headline": f"h{i}", "detail": "d", "ids": [i]} for i in range(n)]})


def test_prompts():
    assert model.prompt(PROMPT, "recap") == "Shared rules.\n- Language: any\n\n## This chunk\n\nBand: recap. Themes.\n"
    assert "- Language: only German." in model.prompt(PROMPT, "regular", "- Language: only German.")
    with pytest.raises(ValueError, match="no band"):
        model.prompt(PROMPT, "media")
    with pytest.raises(ValueError, match="language line"):
        model.prompt("x", rule="- Language: y")


def test_answers_are_read_through_thoughts_and_fences(spark):
    cases = [
        ('<think>{"no"</think>\n```json\n{"a": 1}\n```', None, False, None), ("<think>never ends", None, False, "an empty answer"), ("[1]", None, False, "the answer is no JSON object"), ("{", None, False, "the answer is no JSON"),
        ("", None, False, "an empty answer"), (None, None, False, "an empty answer"), ('{"a": "b', None, True, "the answer was cut off"), (None, 503, False, "status 503"), (None, 402, False, "status 402: the account wants payment"), (None, 0, False, "no answer"),
    ]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, raw string, status int, cut boolean").orderBy("i")
    assert [r[0] for r in rows.select(model.fault(F.col("raw"), F.col("status"), F.col("cut"))).collect()] == [c[3] for c in cases]
    assert rows.select(model.bare(F.col("raw"))).first()[0] == '{"a": 1}'


def test_choice_of_a_model():
    assert model.choose_model("", ["one"]) == "one" and model.choose_model("ONE", ["a-one", "two"]) == "a-one" and model.choose_model("new", ["a"]) == "new" and model.choose_model("x", None) == "x"
    for wanted, offered in (("", ["a", "b"]), ("a", ["ab", "ac"]), ("", None)):
        with pytest.raises(ValueError):
            model.choose_model(wanted, offered)


def _client(folder, said):
    """A client that answers in turn what is said for a message; each call leaves a file."""

    def complete(system, message, schema, most):
        turn = len([f for f in os.listdir(folder) if f.startswith(f"{message}-")])
        open(os.path.join(folder, f"{message}-{turn}"), "x").close()
        answer = said[message][turn]
        if isinstance(answer, Exception):
            raise answer
        return answer if isinstance(answer, model.Answer) else model.Answer(answer, 10, 5)

    return complete


def test_chunks_are_asked_again_once(spark, tmp_path):
    said = {"good": [reply(2)], "thin": [reply(1), reply(1)], "late": ["{", reply(3)], "down": [model.Answer(status=500), TimeoutError()]}
    client = _client(str(tmp_path), said)

    def complete(system, message, schema, most):
        asked = schema["properties"]["items"]
        assert (asked["minItems"], asked["maxItems"], most) == (2, 4, 900) and asked["items"]["properties"]["ids"].get("maxItems") == (5 if message == "good" else None)
        return client(system, message, schema, most)

    rows = [(m, "sys", m, 2, 4, 5 if m == "good" else None, 900, 9) for m in said]
    chunks = spark.createDataFrame(rows, "chunk string, system string, message string, min_items int, max_items int, max_ids int, max_tokens int, posts int")
    run = model.run_chunks(chunks, complete)
    got = {r.chunk: r for r in run.collect()}
    assert run.count() == 4 and sorted(os.listdir(tmp_path)) == ["down-0", "down-1", "good-0", "late-0", "late-1", "thin-0", "thin-1"]
    assert {k: (r.ok, r.attempts) for k, r in got.items()} == {"good": (True, 1), "thin": (False, 2), "late": (True, 2), "down": (False, 2)}
    assert got["thin"].error == "too thin: 1 item(s) for 9 posts, at least 2 expected" and got["down"].error == "no answer" and got["down"].raw is None and got["down"].prompt_tokens is None and got["good"].prompt_chars == 7


def test_known_answers_are_not_asked_for(spark, tmp_path):
    about = lambda x: json.dumps({"summary": x})
    said = {"new": [about("about  new")], "empty": [about("")], "down": [model.Answer(status=402)], "slow": [ConnectionError(), about("late")]}
    complete = _client(str(tmp_path), said)
    texts = spark.createDataFrame([(t,) for t in ("known", "new", "new", "empty", "down", "slow")], "text string")
    cache = spark.createDataFrame([("known",)], "t string").select(language.cache_key("s", F.col("t")).alias("key"), F.lit("kept").alias("answer"))
    got = sorted((r.text, r.answer, r.error, r.cached) for r in model.answered(texts, cache, "s", complete, "summary", {}).collect())
    assert got == [
        ("down", None, "status 402: the account wants payment", False), ("empty", None, "no summary in the answer", False), ("known", "kept", None, True), ("new", "about new", None, False), ("new", "about new", None, False), ("slow", "late", None, False),
    ]


def test_answers_are_kept_and_the_last_one_wins(spark, tmp_path):
    """A second run asks about what failed alone; writing again adds nothing; a later answer takes an earlier one's place."""
    calls, folder = tmp_path / "calls", str(tmp_path / "cache")
    calls.mkdir()
    complete = _client(str(calls), {"a": [json.dumps({"t": "A"})], "b": [model.Answer(status=402), json.dumps({"t": "B"})]})
    texts = spark.createDataFrame([("a",), ("b",), ("a",)], "text string")
    first = model.with_cache(texts, folder, "s", complete, "t", {})
    assert sorted((r.text, r.answer, r.cached) for r in first.collect()) == [("a", "A", False), ("a", "A", False), ("b", None, False)]
    second = model.with_cache(texts, folder, "s", complete, "t", {})
    assert sorted((r.text, r.answer, r.cached) for r in second.collect()) == [("a", "A", True), ("a", "A", True), ("b", "B", False)]
    assert sorted(os.listdir(calls)) == ["a-0", "b-0", "b-1"]
    rows = spark.read.parquet(folder).count()
    model.remember(second, folder)
    assert spark.read.parquet(folder).count() == rows == 2
    key = second.where("text = 'a'").first().key
    model.remember(spark.createDataFrame([(key, "Z")], "key string, answer string"), folder)
    assert {r.answer for r in model.remembered(spark, folder).collect()} == {"Z", "B"}


def test_answers_with_figures_of_their_own_are_withheld(spark):
    rows = spark.createDataFrame([("a", "It rose 1,200 points, says @bob", "Up 1200 says @Bob"), ("b", "It rose", "It rose 7 points"), ("c", "x", None)], "key string, text string, answer string")
    assert {r.key: (r.answer, r.missing) for r in model.supported(rows).collect()} == {"a": ("Up 1200 says @Bob", 0), "b": (None, 1), "c": (None, None)}
    assert [r[0] for r in spark.createDataFrame([(" Ab  c", "aB C"), ("a", "b")], "a string, b string").select(model.same_words(F.col("a"), F.col("b"))).collect()] == [True, False]


@pytest.mark.parametrize("tag, code", [("zh-CN", "zh"), (" EN ", "en"), ("english", None), ("x", None), ("pt_BR", "pt")])
def test_language_codes(spark, tag, code):
    assert spark.range(1).select(language.language_code(F.lit(tag))).first()[0] == code
