"""Runs of a model over chunks: what a reply must be, totals, tokens, what is kept of old files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.export import lookup

# Fixed values measured on the model's tokenizer.
CHARS_PER_TOKEN = 3.6
TOKENS_PER_ITEM = {"regular": 100, "retweet": 100, "recap": 140}
LEAST_REPLY_TOKENS, MOST_REPLY_TOKENS, REPLY_FRAME = 500, 3200, 300
TOKENS_PER_WORD, REPLY_TOKENS = 1.4, 700

#: A reply as it comes: every part may be anything.
LOOSE = "struct<items:array<struct<headline:variant,detail:variant,ids:array<variant>>>>"


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("bigint")


def reply_budget(tier: Column, max_items: Column) -> Column:
    """Tokens a chunk's reply may take: room for its most items and what stands around them."""
    return F.least(F.lit(MOST_REPLY_TOKENS), F.greatest(F.lit(LEAST_REPLY_TOKENS), lookup(TOKENS_PER_ITEM, tier) * max_items + REPLY_FRAME)).cast("bigint")


def _kind(v: Column) -> Column:
    """A value's type as variant names it: OBJECT, ARRAY<..>, STRING, BIGINT, BOOLEAN, ..."""
    return F.schema_of_variant(v)


def reply_problem(raw: Column, min_items: Column, posts: Column) -> Column:
    """What is wrong with a reply (JSON text of an object), or null."""
    items = F.try_variant_get(F.try_parse_json(raw), "$.items", "array<variant>")
    problems = F.transform(items, lambda item, k: _item_problem(item, k))
    first = F.get(F.filter(problems, lambda p: p.isNotNull()), F.lit(0))
    n = F.size(items)
    thin = F.when(n < min_items, F.concat(F.lit("too thin: "), n.cast("string"), F.lit(" item(s) for "), posts.cast("string"), F.lit(" posts, at least "), min_items.cast("string"), F.lit(" expected")))
    return F.when(items.isNull(), "no `items` list").otherwise(F.coalesce(first, thin))


def _item_problem(item: Column, k: Column) -> Column:
    at = k.cast("string")
    part = lambda name: F.try_variant_get(item, f"$.{name}", "variant")
    text = lambda name: F.coalesce(_kind(part(name)) == "STRING", F.lit(False))
    ids = F.try_variant_get(item, "$.ids", "array<variant>")
    whole = F.coalesce(F.forall(ids, lambda v: _kind(v) == "BIGINT"), F.lit(False))
    return (
        F.when(~F.startswith(_kind(item), F.lit("OBJECT")), F.concat(F.lit("item "), at, F.lit(" is not an object")))
        .when(~(text("headline") & text("detail")), F.concat(F.lit("item "), at, F.lit(": headline and detail must be strings")))
        .when(~whole, F.concat(F.lit("item "), at, F.lit(": ids must be a list of integers")))
    )


def run_totals(results: DataFrame, *keys: str) -> DataFrame:
    """Totals of runs: counts, seconds, tokens, reply words against target, characters a token.

    ``results``: ok, seconds, prompt_chars, prompt_tokens, completion_tokens, reply_words, target_words; a chunk that
    came to no answer has null tokens.
    """
    counted = F.coalesce(F.col("prompt_tokens") > 0, F.lit(False))
    tokens = F.sum(F.when(counted, F.col("prompt_tokens")))
    return results.groupBy(*keys).agg(
        F.count("*").alias("chunks"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.bround(F.sum("seconds"), 1).alias("seconds"),
        F.coalesce(tokens, F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("reply_words"))), F.lit(0)).alias("reply_words"), F.sum("target_words").alias("target_words"),
        F.bround(F.sum(F.when(counted, F.col("prompt_chars"))) / tokens, 2).alias("chars_per_token"),
    )


def newest(files: DataFrame, *keys: str) -> DataFrame:
    """The file written last of each group; of equal times the greatest name."""
    return files.groupBy(*keys).agg(F.max_by("name", F.struct("mtime", "name")).alias("name"), F.max("mtime").alias("mtime"))


def forgotten(files: DataFrame, before: Column) -> DataFrame:
    """Entries to delete: ``folder`` (runs, exports), ``entry``.

    ``files``: folder, entry, mtime, export (the stem that a run's manifest names).  An entry is as old as its newest
    file; an export that a kept run was made from stays whatever its age.
    """
    entries = files.groupBy("folder", "entry").agg(F.max("mtime").alias("mtime"), F.max("export").alias("export")).withColumn("old", F.col("mtime") < before)
    needed = entries.where((F.col("folder") == "runs") & ~F.col("old") & F.col("export").isNotNull()).select(F.col("export").alias("stem")).distinct()
    marked = entries.where("old").withColumn("stem", F.when(F.col("folder") == "exports", F.substring_index("entry", ".", 1)))
    return marked.join(needed, "stem", "left_anti").select("folder", "entry")


def freeze_manifest(items: DataFrame) -> DataFrame:
    """Of a frozen window: items, words, image posts and pictures of each tier."""
    media = F.col("tier") == "media"
    return items.groupBy("tier").agg(
        F.count("*").alias("items"), F.sum("words").alias("words"), F.count_if(media).alias("image_posts"), F.coalesce(F.sum(F.when(media, F.size("images"))), F.lit(0)).alias("images"),
    )


def estimate_cost(prompts: DataFrame, per_in: float, per_out: float, *keys: str) -> DataFrame:
    """Tokens that summaries are reckoned at, and their price; ``prompts``: words of system and message."""
    tokens_in = F.bround(F.sum("words").cast("double") * F.lit(TOKENS_PER_WORD)).cast("bigint")
    sums = prompts.groupBy(*keys).agg(tokens_in.alias("tokens_in"), (F.count("*") * REPLY_TOKENS).alias("tokens_out"))
    return sums.withColumn("cost", F.col("tokens_in") * F.lit(per_in) + F.col("tokens_out") * F.lit(per_out))


def usage(calls: DataFrame, *keys: str) -> DataFrame:
    """Tokens the server counted; a call without a count isn't one."""
    counted = calls.where(F.col("prompt_tokens").isNotNull())
    return counted.groupBy(*keys).agg(F.sum("prompt_tokens").alias("tokens_in"), F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("tokens_out"), F.count("*").alias("calls"))
