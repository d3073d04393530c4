"""Feeds: readers of stored posts and upstream pages, and the feed that the test tables stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions import text as X

#: A normalized post, as stored.
ITEM = T.StructType(
    [T.StructField(n, T.StringType(), False) for n in ("id", "source", "source_type", "title", "url")]
    + [
        T.StructField("author", T.StringType()), T.StructField("published", T.TimestampNTZType()),
        T.StructField("text", T.StringType()), T.StructField("full_text", T.StringType()),
        T.StructField("images", T.ArrayType(T.StringType())), T.StructField("grp", T.StringType()),
        T.StructField("retweet_of_author", T.StringType()), T.StructField("retweet_of_text", T.StringType()),
        T.StructField("fetched_at", T.TimestampNTZType()),
    ]
)

def _user(name: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType())])


def _post(name: str) -> T.StructType:
    return T.StructType([T.StructField("text", T.StringType()), T.StructField("author", _user(name))])


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


#: A post of the backend that bills by post.
TIMELINE = T.StructType(
    _strings("url", "text", "createdAt", "inReplyToUsername", "conversationId", "id")
    + [
        T.StructField("isReply", T.BooleanType()), T.StructField("author", _user("userName")),
        T.StructField("retweeted_tweet", _post("userName")), T.StructField("quoted_tweet", _post("userName")),
        T.StructField("extendedEntities", T.StructType([T.StructField("media", T.ArrayType(T.StructType(_strings("media_url_https"))))])),
    ]
)

#: A post of the backend that bills by call.
TIMELINE_BY_CALL = T.StructType(
    _strings("url", "text", "createdAt", "conversationId", "id")
    + [
        T.StructField("replyTo", T.StructType(_strings("tweetId", "username"))), T.StructField("author", _user("username")),
        T.StructField("retweetedTweet", _post("username")), T.StructField("quotedTweet", _post("username")),
        T.StructField("media", T.ArrayType(T.StructType(_strings("thumbnailUrl", "url")))),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_items(spark: SparkSession, path: str) -> DataFrame:
    """The stored columns alone, so that a scan reads no others."""
    return spark.read.schema(ITEM).parquet(path)


def timeline_items(pages: DataFrame, source_type: str = "x") -> DataFrame:
    """Posts from rows of TIMELINE (one a post), normalized."""
    reply = F.when(F.col("isReply") | F.col("inReplyToUsername").isNotNull(), F.col("inReplyToUsername"))
    titled = F.when(F.col("isReply"), F.col("inReplyToUsername"))
    return _normalized(pages, source_type, F.col("author.userName"), reply, titled, F.col("retweeted_tweet"), F.col("quoted_tweet"), "userName", F.col("extendedEntities.media.media_url_https"))


def timeline_items_by_call(pages: DataFrame, source_type: str = "x") -> DataFrame:
    """The same from rows of TIMELINE_BY_CALL."""
    media = F.transform("media", lambda m: F.coalesce(F.nullif(m["thumbnailUrl"], F.lit("")), m["url"]))
    reply = F.col("replyTo.username")
    return _normalized(pages, source_type, F.col("author.username"), reply, reply, F.col("retweetedTweet"), F.col("quotedTweet"), "username", media)


def _normalized(pages: DataFrame, source_type: str, author, reply, titled, retweeted, quoted, name: str, media) -> DataFrame:
    """Title, shared post, added comment, thread root, pictures, time of a post, whoever sent it."""
    who, told = F.coalesce(author, F.lit("")), F.coalesce(X.collapse(F.col("text")), F.lit(""))
    shared = F.coalesce(retweeted, quoted)
    by = F.coalesce(shared["author"][name], F.lit(""))
    original = F.when(by == "", "").otherwise(F.coalesce(X.collapse(shared["text"]), F.lit("")))
    title = (
        F.when(retweeted.isNotNull(), F.when(by == "", told).otherwise(F.concat(F.lit("RT @"), by, F.lit(": "), original)))
        .when(F.coalesce(titled, F.lit("")) != "", F.concat(F.lit("R to @"), titled, F.lit(": "), told)).otherwise(told)
    )
    echo = F.startswith(F.lower(told), F.concat(F.lit("rt @"), F.lower(by), F.lit(":"))) | X.is_echo(told, original)
    words = F.when(by == "", title).when(echo, "").otherwise(told)
    own_thread = retweeted.isNull() & (F.coalesce(reply, F.lit("")) != "") & (F.lower(reply) == F.lower(who)) & (F.coalesce("conversationId", F.lit("")) != "") & (F.col("conversationId") != F.coalesce("id", F.lit("")))
    # Spark doesn't parse day names, so they are cut off.
    named = F.try_to_timestamp(F.expr("substring(createdAt, 5)"), F.lit("MMM dd HH:mm:ss Z yyyy"))
    iso = F.when(F.col("createdAt").rlike(r"^\d{4}-\d\d-\d\dT[\d:.]+Z$"), F.try_to_timestamp("createdAt"))
    url = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.concat(F.lit("https://x.com/"), who, F.lit("/status/"), F.col("id")))
    pictures = F.coalesce(F.array_distinct(F.filter(media, lambda m: m.isNotNull() & (m != ""))), F.array().cast("array<string>"))
    return pages.select(
        F.substring(F.sha2(url, 256), 1, 16).alias("id"), F.concat(F.lit("@"), who).alias("source"), F.lit(source_type).alias("source_type"),
        F.substring(title, 1, 200).alias("title"), url.alias("url"), who.alias("author"), F.coalesce(named, iso).cast("timestamp_ntz").alias("published"),
        words.alias("full_text"), pictures.alias("images"), by.alias("retweet_of_author"), original.alias("retweet_of_text"),
        F.when(own_thread, F.col("conversationId")).otherwise("").alias("thread_root"),
    )


def derived_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed that ``documents`` stands for: posts a minute apart, some of them retweets, echoes, quotes, pictures."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    kind = F.col("doc_id") % 10
    # Only posts that may share another, and those they share, meet.
    before = docs.where(((F.col("doc_id") + 1) % 10).isin(3, 7, 9)).select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("p_text"), F.col("source").alias("p_source"))
    sharing = docs.where(kind.isin(3, 7, 9)).join(before, "doc_id", "left")
    alone = docs.where(~kind.isin(3, 7, 9)).withColumns({"p_text": F.lit(None).cast("string"), "p_source": F.lit(None).cast("string")})
    shares = kind.isin(3, 7, 9) & F.col("p_source").isNotNull()
    full = F.when(kind == 3, "").when((kind == 7) & F.col("p_text").isNotNull(), F.substring("p_text", 1, 280)).otherwise(F.col("text"))
    when = F.timestamp_add("MINUTE", F.col("doc_id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    prefix = F.when((kind == 3) & shares, F.concat(F.lit("RT @"), "p_source", F.lit(": "), "p_text")).when(kind == 8, F.concat(F.lit("R to @src"), (F.col("doc_id") % 20).cast("string"), F.lit(": "), "text")).otherwise(full)
    url = F.concat(F.lit("https://x.com/"), "source", F.lit("/status/"), F.col("doc_id").cast("string"))
    pictures = F.when(kind == 5, F.transform(F.sequence(F.lit(1), (1 + F.col("doc_id") % 6).cast("int")), lambda i: F.concat(F.lit("https://pic/"), F.col("doc_id").cast("string"), F.lit("/"), i.cast("string"))))
    return sharing.unionByName(alone).select(
        "doc_id", F.substring(F.sha2(url, 256), 1, 16).alias("id"), F.concat(F.lit("@"), "source").alias("source"), F.lit("x").alias("source_type"),
        F.substring(F.coalesce(prefix, F.lit("")), 1, 200).alias("title"), url.alias("url"), F.col("source").alias("author"),
        F.when(F.col("doc_id") % 50 != 49, when).alias("published"), F.lit("").alias("text"), F.coalesce(full, F.lit("")).alias("full_text"),
        F.coalesce(pictures, F.array().cast("array<string>")).alias("images"), F.when(F.col("lang") == "en", "").otherwise(F.coalesce("lang", F.lit(""))).alias("grp"),
        F.when(shares, F.col("p_source")).otherwise("").alias("retweet_of_author"), F.when(shares, F.coalesce("p_text", F.lit(""))).otherwise("").alias("retweet_of_text"),
        F.timestamp_add("MINUTE", F.lit(5), when).alias("fetched_at"),
    )


def derived_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The follow list: one row a source, some with settings."""
    docs = table(spark, sf_dir, "documents").select("source").distinct()
    number = F.substring("source", 4, 10).cast("int")
    return docs.select(F.concat(F.lit("@"), "source").alias("name"), (number == 3).alias("priority"), (number % 4 != 1).alias("reposts"), F.when(number % 5 == 0, "low").when(number % 5 == 1, "high").otherwise("normal").alias("level"))
