"""Calls of a language model over rows: prompts, replies, one more try, answers that are kept.

A client says what came of a call as an ``Answer``; what is wrong with it, and whether it is asked again, is worked
out on columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.text import collapse
from feedloom.operators import language, runs, verify
from feedloom.plans.lineage import checkpointed

# Marks of a prompt file, and what a status says that neither settings nor another try will change.
FENCE, BAND, LANGUAGE = "---", "## Band:", "- Language:"
STATUS_WORDS = {401: "the key was turned down", 403: "the key was turned down", 402: "the account wants payment", 429: "the rate limit was reached"}


@dataclass
class Answer:
    """What came of a call: a text, or the status of a refusal (0: nothing came at all)."""

    text: str | None = None
    prompt_tokens: int | None = None
    completion_tokens: int | None = None
    cut: bool = False
    status: int | None = None


#: What a client is: (system, message, schema, most tokens) -> Answer.
Complete = Callable[[str, str, dict, int], Answer]


def prompt_lines(text: str) -> Iterator[tuple[str, str]]:
    """Lines of a prompt file behind its front matter, each with the band it is for ("": all)."""
    lines, band = text.split("\n"), ""
    if lines[0] == FENCE and FENCE in lines[1:]:
        lines = lines[lines.index(FENCE, 1) + 1 :]
    for line in lines:
        if line.startswith(BAND):
            band = line.removeprefix(BAND).strip()
            yield band, ""
        else:
            yield band, line


def prompt(text: str, band: str | None = None, rule: str | None = None) -> str:
    """The prompt for one band (None: the file as it is), its language line replaced by a rule."""
    rows = list(prompt_lines(text))
    at = next((i for i, (_, line) in enumerate(rows) if line.startswith(LANGUAGE)), None)
    if rule and at is None:
        raise ValueError("the prompt has no language line to replace")
    if rule:
        rows[at] = (rows[at][0], rule)
    own = {b: "\n".join(line for x, line in rows if x == b).strip() for b in dict.fromkeys(b for b, _ in rows)}
    if band is None:
        return "\n\n".join(f"{BAND} {b}\n{body}" if b else body for b, body in own.items()) + "\n"
    if band not in own:
        raise ValueError(f"the prompt has no band {band}")
    return f"{own.get('', '')}\n\n## This chunk\n\nBand: {band}. {own[band]}\n"


def reply_schema(least: int, most: int, most_ids: int | None = None) -> dict:
    """The shape a chunk's reply is asked in."""
    ids = {"type": "array", "items": {"type": "integer"}} | ({"maxItems": most_ids} if most_ids else {})
    item = {"type": "object", "properties": {"headline": {"type": "string"}, "detail": {"type": "string"}, "ids": ids}, "required": ["headline", "detail", "ids"], "additionalProperties": False}
    return {"type": "object", "properties": {"items": {"type": "array", "items": item, "minItems": least, "maxItems": most}}, "required": ["items"], "additionalProperties": False}


def choose_model(wanted: str, offered: list[str] | None) -> str:
    """The id of a model: as named, the only one that has the name in it, or the only one there is."""
    if offered is None or (wanted and wanted in offered):
        if not wanted:
            raise ValueError("no list of models, and none named")
        return wanted
    fits = [m for m in offered if wanted.lower() in m.lower()]
    if len(fits) == 1:
        return fits[0]
    if wanted and not fits:
        return wanted
    raise ValueError(f"{len(fits)} models fit, name one: " + ", ".join(fits))


def bare(raw: Column) -> Column:
    """A reply without thoughts and code fences; one whose thoughts never end is empty."""
    thoughtless = F.regexp_replace(raw, r"(?s)<think>.*?(?:</think>|$)", "")
    return F.regexp_replace(F.trim(thoughtless), r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")


def fault(raw: Column, status: Column, cut: Column) -> Column:
    """Why no JSON object came of a call, or null."""
    said = F.concat(F.lit("status "), status.cast("string"), *[F.when(status == n, f": {words}").otherwise("") for n, words in STATUS_WORDS.items()])
    value = F.try_parse_json(bare(raw))
    return (
        F.when(status == 0, "no answer").when(status.isNotNull(), said).when(F.coalesce(bare(raw), F.lit("")) == "", "an empty answer")
        .when(value.isNull(), F.when(cut, "the answer was cut off").otherwise("the answer is no JSON")).when(~F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), "the answer is no JSON object")
    )


_CALL = "raw string, status int, cut boolean, prompt_tokens bigint, completion_tokens bigint"


def asked(rows: DataFrame, complete: Complete, schema_of: Callable[[dict], dict]) -> DataFrame:
    """``rows`` (system, message, max_tokens and whatever ``schema_of`` reads) with what came of one call each, kept: a later reading asks nothing.

    Each task calls in turn, so as many calls run at once as there are tasks.
    """
    columns = [c for c in rows.columns if c not in ("raw", "status", "cut", "prompt_tokens", "completion_tokens")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for row in frame.to_dict("records"):
                try:
                    found.append(complete(row["system"], row["message"], schema_of(row), int(row["max_tokens"])))
                except OSError:  # time-outs and broken connections
                    found.append(Answer(status=0))
            told = pd.DataFrame([(a.text, a.status, a.cut, a.prompt_tokens, a.completion_tokens) for a in found], columns=["raw", "status", "cut", "prompt_tokens", "completion_tokens"])
            yield pd.concat([frame.reset_index(drop=True), told.astype({"status": "Int32", "prompt_tokens": "Int64", "completion_tokens": "Int64"})], axis=1)

    own = ", ".join(f"`{c}` {t}" for c, t in rows.select(columns).dtypes)
    return checkpointed(rows.select(columns).mapInPandas(run, f"{own}, {_CALL}"))


def run_chunks(chunks: DataFrame, complete: Complete, retries: int = 1) -> DataFrame:
    """Every chunk's record: ``chunk``, ``ok``, ``attempts``, ``raw``, ``error``, ``prompt_chars``, tokens.

    ``chunks``: chunk, system, message, min_items, max_items, max_ids, max_tokens, posts.  Chunks whose call fails, or
    whose reply ``runs.reply_problem`` finds fault with, are a further round of up to ``retries``; the last fault is kept.
    """
    shape = lambda row: reply_schema(int(row["min_items"]), int(row["max_items"]), None if pd.isna(row["max_ids"]) else int(row["max_ids"]))
    left, done = chunks, None
    for attempt in range(1, retries + 2):
        problem = F.coalesce(fault(F.col("raw"), F.col("status"), F.col("cut")), runs.reply_problem(bare(F.col("raw")), F.col("min_items"), F.col("posts")))
        told = asked(left, complete, shape).withColumns({"error": problem, "attempts": F.lit(attempt)})
        over = told if attempt > retries else told.where("error is null")
        done = over if done is None else done.unionByName(over)
        left = told.where("error is not null").select(chunks.columns)
    size = (F.length("system") + F.length("message")).cast("bigint")
    return done.select("chunk", F.col("error").isNull().alias("ok"), "attempts", "raw", "error", size.alias("prompt_chars"), "prompt_tokens", "completion_tokens")


def answered(texts: DataFrame, cache: DataFrame, system: str, complete: Complete, part: str, schema: dict, max_tokens: int = 300) -> DataFrame:
    """``texts`` (text) with ``key``, ``answer`` (the reply's string ``part``), ``error`` and ``cached``.

    Equal texts are asked about once, those in the cache (key, answer) not at all; an empty part is an error; a call
    that nothing came of, or that the server failed, is made once more.
    """
    keyed = language.split_by_cache(texts, cache, system)
    misses = keyed.where("answer is null").select("key", F.lit(system).alias("system"), F.col("text").alias("message"), F.lit(max_tokens).alias("max_tokens")).dropDuplicates(["key"])
    first = asked(misses, complete, lambda row: schema)
    again = F.coalesce((F.col("status") == 0) | (F.col("status") >= 500), F.lit(False))
    told = first.where(~again).unionByName(asked(first.where(again).select(misses.columns), complete, lambda row: schema))
    value = F.nullif(collapse(F.try_variant_get(F.try_parse_json(bare(F.col("raw"))), f"$.{part}", "string")), F.lit(""))
    why = F.coalesce(fault(F.col("raw"), F.col("status"), F.col("cut")), F.when(value.isNull(), f"no {part} in the answer"))
    said = told.select("key", F.when(why.isNull(), value).alias("_said"), why.alias("error"))
    found = keyed.withColumn("cached", F.col("answer").isNotNull()).join(said, "key", "left")
    return found.withColumn("answer", F.coalesce("answer", "_said")).drop("_said")


# -- answers that are kept ------------------------------------------------------------------------


def remembered(spark: SparkSession, folder: str) -> DataFrame:
    """``key``, ``answer`` of a cache: of several answers to one question the one kept last, ties by text; none where there is no cache yet."""
    try:
        rows = spark.read.schema("key string, answer string, kept_at timestamp").parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "key string, answer string")
    return rows.groupBy("key").agg(F.max(F.struct("kept_at", "answer"))["answer"].alias("answer"))


def remember(answers: DataFrame, folder: str) -> None:
    """Append what the cache doesn't say yet; written again it adds nothing. Errors are not kept."""
    spark = answers.sparkSession
    fresh = checkpointed(answers.where("answer is not null").select("key", "answer").distinct().join(remembered(spark, folder), ["key", "answer"], "left_anti"))
    if not fresh.isEmpty():
        fresh.withColumn("kept_at", F.current_timestamp()).write.mode("append").parquet(folder)


def with_cache(texts: DataFrame, folder: str, system: str, complete: Complete, part: str, schema: dict, max_tokens: int = 300) -> DataFrame:
    """``answered`` from the cache in ``folder``, into which new answers go before anyone reads them."""
    found = checkpointed(answered(texts, remembered(texts.sparkSession, folder), system, complete, part, schema, max_tokens))
    remember(found.where("not cached"), folder)
    return found


def supported(answers: DataFrame) -> DataFrame:
    """``answers`` (key, text, answer) with ``missing``: figures, handles and tickers that the text never had; such answers are withheld."""
    numbered = answers.select("key", "text", "answer").where("answer is not null").dropDuplicates(["key"])
    items = numbered.select(F.col("key").alias("item"), F.lit("").alias("headline"), F.col("answer").alias("detail"), F.array(F.col("key")).alias("ids"))
    held = verify.support(items, numbered.select(F.col("key").alias("n"), "text")).select(F.col("item").alias("key"), F.col("unsupported_facts").alias("missing"))
    return answers.join(held, "key", "left").withColumn("answer", F.when(F.coalesce("missing", F.lit(0)) == 0, F.col("answer")))


def same_words(a: Column, b: Column) -> Column:
    """Whether a translation is the text itself, case and spaces aside."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return plain(a) == plain(b)
