"""Registered queries of the feed operators, with their oracles in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.functions import text as X
from feedloom.operators import export, posts, reading, stories, topics, verify
from feedloom.plans import numbering
from feedloom.sources import exports, pictures, store
from feedloom.sources.feed import derived_feed, derived_sources, table
from feedloom.streaming import feeds, silence

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PRIORITY, RECAP, SILENCE = "@src3", "de", "30 minutes"
DAY, NEXT_DAY = "2024-01-01 04:00:00", "2024-01-01 10:00:00"
FROZEN = "2024-01-01 01:00:00"

# -- the derived feed, in SQL ---------------------------------------------------------------------

_WHITE, _SOLID = r"[\s\x0b\x1c-\x1f\x{85}\pZ]", r"[^\s\x0b\x1c-\x1f\x{85}\pZ]"
_URL = f"https?://{_SOLID}+"


def _unescape(x: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WHITE}+', ' ', 'g'))"


def _no_urls(x: str) -> str:
    return f"regexp_replace({x}, '{_URL}', ' ', 'g')"


def _comparable(x: str) -> str:
    return _collapse(f"lower({_no_urls(_unescape(x))})")


def _cut(a: str, b: str) -> str:
    stem = rf"regexp_replace({a}, '\s*(?:…|\.\.\.)\s*$', '')"
    return f"({stem} <> {a} AND length({stem}) >= 20 AND starts_with({b}, {stem}))"


_STOP = ", ".join(f"'{w}'" for w in X.STORY_STOP)

FEED = f"""
raw AS (SELECT d.doc_id, d.text AS dtext, coalesce(d.lang, '') AS lang, d.source AS src, p.text AS p_text, p.source AS p_source, d.doc_id % 10 AS kind, d.doc_id % 10 IN (3, 7, 9) AND p.source IS NOT NULL AS shares
  FROM documents d LEFT JOIN documents p ON p.doc_id = d.doc_id - 1),
base AS (SELECT doc_id, '@' || src AS source, 'x' AS source_type, src AS author, 'https://x.com/' || src || '/status/' || doc_id AS url,
  CASE WHEN doc_id % 50 <> 49 THEN TIMESTAMP '2024-01-01' + to_minutes(doc_id) END AS published, TIMESTAMP '2024-01-01' + to_minutes(doc_id + 5) AS fetched_at,
  CASE WHEN kind = 3 THEN '' WHEN kind = 7 AND p_text IS NOT NULL THEN substr(p_text, 1, 280) ELSE coalesce(dtext, '') END AS full_text,
  CASE WHEN kind = 5 THEN 1 + doc_id % 6 ELSE 0 END AS n_images, CASE WHEN lang = 'en' THEN '' ELSE lang END AS grp,
  CASE WHEN shares THEN p_source ELSE '' END AS retweet_of_author, CASE WHEN shares THEN coalesce(p_text, '') ELSE '' END AS retweet_of_text,
  substr(coalesce(CASE WHEN kind = 3 AND shares THEN 'RT @' || p_source || ': ' || p_text WHEN kind = 8 THEN 'R to @src' || (doc_id % 20) || ': ' || dtext WHEN kind = 3 THEN '' WHEN kind = 7 AND p_text IS NOT NULL THEN substr(p_text, 1, 280) ELSE dtext END, ''), 1, 200) AS title
  FROM raw),
compared AS (SELECT *, substr(sha256(url), 1, 16) AS id, {_comparable("full_text")} AS ca, {_comparable("retweet_of_text")} AS cb FROM base),
owned AS (SELECT *, CASE WHEN retweet_of_author <> '' AND ca <> '' AND cb <> '' AND (ca = cb OR (length(ca) >= 100 AND starts_with(cb, ca)) OR {_cut("ca", "cb")} OR {_cut("cb", "ca")}) THEN '' ELSE full_text END AS own FROM compared),
pured AS (SELECT *, retweet_of_author <> '' AND trim(regexp_replace(own, '{_URL}', '', 'g')) = '' AS pure,
  CASE WHEN grp = '' THEN 'x' ELSE 'x/' || grp END AS section,
  CASE WHEN retweet_of_author = '' THEN own WHEN own = '' THEN '🔁 Retweeted @' || retweet_of_author || ': ' || retweet_of_text ELSE own || chr(10) || chr(10) || '🔁 Retweeted @' || retweet_of_author || ': ' || retweet_of_text END AS body,
  CASE WHEN retweet_of_author <> '' AND retweet_of_text <> '' THEN retweet_of_text ELSE own END AS story,
  (SELECT max(q.published) FROM base q WHERE false) AS nothing FROM owned),
quiet AS (SELECT f.*, max(published) OVER (PARTITION BY source ORDER BY published RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS previous FROM pured f),
feed AS (SELECT *, len(regexp_extract_all({_no_urls(_unescape("body"))}, '\\S+')) AS words, coalesce(published > previous + INTERVAL 30 MINUTE, false) AS after_silence,
  CASE WHEN source = '{PRIORITY}' OR (coalesce(published > previous + INTERVAL 30 MINUTE, false) AND NOT pure) THEN 'priority' WHEN n_images > 0 THEN 'media' WHEN grp = '{RECAP}' THEN 'recap' WHEN pure THEN 'retweet' ELSE 'regular' END AS tier FROM quiet)
"""
FEED = FEED.replace(",\n  (SELECT max(q.published) FROM base q WHERE false) AS nothing FROM owned", " FROM owned")

SOURCES = """
sources AS (SELECT DISTINCT '@' || source AS name, CAST(substr(source, 4) AS INT) = 3 AS priority, CAST(substr(source, 4) AS INT) % 4 <> 1 AS reposts,
  CASE CAST(substr(source, 4) AS INT) % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'normal' END AS level FROM documents)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def feed_sql(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([FEED, *ctes]) + "\n" + body


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived feed with own words, silence, section and tier."""
    items = posts.with_words(derived_feed(spark, sf_dir)).withColumn("section", X.section_key(F.col("source_type"), F.col("grp")))
    quiet = posts.silence(items, "source", "published", SILENCE)
    return quiet.withColumn("tier", posts.tier_of(F.col("source") == PRIORITY, F.col("grp") == RECAP))


def _n(name: str = "n"):
    return F.count("*").alias(name)


# -- rows and tiers -------------------------------------------------------------------------------


@query(feed_sql("SELECT doc_id, id, source, grp, tier, CAST(words AS BIGINT) AS words, after_silence, published FROM feed"))
def feed_items(spark, sf_dir):
    return feed(spark, sf_dir).select("doc_id", "id", "source", "grp", "tier", "words", "after_silence", "published")


@query(feed_sql("SELECT doc_id, id FROM compared"))
def item_id(spark, sf_dir):
    return derived_feed(spark, sf_dir).select("doc_id", "id")


@query(feed_sql("SELECT doc_id, pure, own = '' AS silent, CAST(words AS BIGINT) AS words FROM feed"))
def word_count(spark, sf_dir):
    return feed(spark, sf_dir).select("doc_id", "pure", (F.col("own") == "").alias("silent"), "words")


@query(feed_sql("SELECT t.tier, count(f.doc_id) AS items, CAST(coalesce(sum(f.words), 0) AS BIGINT) AS words FROM (VALUES ('priority'), ('media'), ('recap'), ('retweet'), ('regular')) t(tier) LEFT JOIN feed f ON f.tier = t.tier GROUP BY t.tier"))
def tier_counts(spark, sf_dir):
    tiers = spark.createDataFrame([(t,) for t in ("priority", "media", "recap", "retweet", "regular")], "tier string")
    counts = feed(spark, sf_dir).groupBy("tier").agg(_n("items"), F.sum("words").alias("words"))
    return tiers.join(counts, "tier", "left").select("tier", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("words", F.lit(0)).alias("words"))


@query(feed_sql("SELECT section, count(*) AS items, count(DISTINCT source) AS sources FROM feed GROUP BY section"))
def section_items(spark, sf_dir):
    return feed(spark, sf_dir).groupBy("section").agg(_n("items"), F.countDistinct("source").alias("sources"))


@query(feed_sql("SELECT f.doc_id, s.level, s.reposts FROM feed f LEFT JOIN sources s ON s.name = f.source", SOURCES))
def source_join(spark, sf_dir):
    return feed(spark, sf_dir).join(derived_sources(spark, sf_dir), F.col("source") == F.col("name"), "left").select("doc_id", "level", "reposts")


# -- filters and duplicates -----------------------------------------------------------------------

HIDE, ONLY = ["idiot", "password"], ["the"]


def _said(words: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches(lower({p}), '(^|[^0-9a-zÀ-ɏ]){w}')" for w in words for p in ("title", "full_text", "retweet_of_text")) + ")"


_TARGET = r"lower(regexp_extract(title, '^R to @([^:\s]+)', 1))"
_REASON = f"""CASE WHEN (starts_with(title, 'RT by @') OR starts_with(title, 'RT @')) AND NOT s.reposts THEN 'retweets'
 WHEN starts_with(title, 'R to @') AND NOT ({_TARGET} = lower(author) OR '@' || {_TARGET} = lower(source)) THEN 'replies'
 WHEN {_said(HIDE)} THEN 'hidden keywords' WHEN source = '@src7' AND NOT {_said(ONLY)} THEN 'outside only:' END"""


@query(feed_sql(f"SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT {_REASON} AS reason FROM feed f JOIN sources s ON s.name = f.source) GROUP BY ALL", SOURCES))
def drop_reasons(spark, sf_dir):
    items = feed(spark, sf_dir).join(derived_sources(spark, sf_dir), F.col("source") == F.col("name")).withColumn("thread_reply", F.lit(False))
    reason = posts.drop_reason(HIDE, F.col("source") == "@src7", ONLY)
    return items.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(_n())


@query(feed_sql(f"SELECT doc_id FROM feed WHERE {_said(HIDE)}"))
def keyword_hide(spark, sf_dir):
    said = [X.mentions(F.col(p), w) for w in HIDE for p in ("title", "full_text", "retweet_of_text")]
    return feed(spark, sf_dir).where(posts._any(said)).select("doc_id")


@query(feed_sql(f"SELECT doc_id FROM feed WHERE source <> '@src7' OR {_said(ONLY)}"))
def keyword_only(spark, sf_dir):
    said = [X.mentions(F.col(p), w) for w in ONLY for p in ("title", "full_text", "retweet_of_text")]
    return feed(spark, sf_dir).where((F.col("source") != "@src7") | posts._any(said)).select("doc_id")


def _plain(x: str, decoded: bool) -> str:
    links = rf"regexp_replace({x if decoded else _unescape(x)}, '(?i)(?:https?://(?:[\w-]+\.)*(?:x|twitter)\.com|\bpic\.(?:x|twitter)\.com)/{_SOLID}*', ' ', 'g')"
    return _collapse(rf"lower(CASE WHEN n_images > 0 THEN regexp_replace({links}, '(?i)https?://t\.co/{_SOLID}*', ' ', 'g') ELSE {links} END)")


def _content(decoded: bool = False) -> str:
    own, shared, title = (_plain(c, decoded) for c in ("own", "retweet_of_text", "title"))
    return f"CASE WHEN retweet_of_author <> '' THEN {own} || chr(10) || '@' || lower(retweet_of_author) || ': ' || {shared} WHEN {own} <> '' THEN {own} ELSE {title} END"


_KEYED = f"""keyed AS (SELECT doc_id, source, CAST(doc_id AS VARCHAR) AS status, n_images, CASE WHEN content = '' AND n_images = 0 THEN NULL ELSE lower(author) || '|' || content || '|' || CASE WHEN n_images > 0 THEN doc_id || '/' || n_images ELSE '' END END AS key FROM
 (SELECT *, {_content()} AS content FROM feed))"""


#: Entities of every form, spaces of every form, links to X, and what they say: before or behind each post, and in what it shares.
_PLANTED = "caf&eacute; &#8217;&#x2019 R&ampD &amp;lt; a\u00a0b\u3000c\x1cd &nbsp; &notit; &bogus; &#150; https://x.com/a/1\u00a0e https://t.co/q f pic.x.com/z&amp;y "
_SAID = "café ’’ R&D &lt; a\u00a0b\u3000c\x1cd \u00a0 ¬it; &bogus; – https://x.com/a/1\u00a0e https://t.co/q f pic.x.com/z&y "


@query(f"""WITH posts AS (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN '' WHEN doc_id % 2 = 0 THEN '{_SAID}' || coalesce(text, '') ELSE coalesce(text, '') || '{_SAID}' END AS own, CASE WHEN doc_id % 5 = 0 THEN source ELSE '' END AS retweet_of_author,
 '{_SAID}' || source AS retweet_of_text, '{_SAID}' || substr(coalesce(text, ''), 1, 50) AS title, doc_id % 7 % 2 AS n_images FROM documents)
SELECT doc_id, CAST(len(regexp_extract_all({_no_urls("own")}, '{_SOLID}+')) AS BIGINT) AS words, md5({_collapse(f"lower({_no_urls('own')})")}) AS comparable, md5({_content(decoded=True)}) AS content FROM posts""")
def text_rules(spark, sf_dir):
    """Number of words, comparable form and duplicate key of posts with entities, Unicode spaces and links to X."""
    docs, text, planted = table(spark, sf_dir, "documents"), F.coalesce("text", F.lit("")), F.lit(_PLANTED)
    own = F.when(F.col("doc_id") % 3 == 1, "").when(F.col("doc_id") % 2 == 0, F.concat(planted, text)).otherwise(F.concat(text, planted))
    rows = docs.select(
        "doc_id", own.alias("own"), F.when(F.col("doc_id") % 5 == 0, F.col("source")).otherwise("").alias("retweet_of_author"), F.concat(planted, "source").alias("retweet_of_text"),
        F.concat(planted, F.substring(text, 1, 50)).alias("title"), F.array_repeat(F.lit("p"), (F.col("doc_id") % 7 % 2).cast("int")).alias("images"),
    )
    return rows.select("doc_id", X.word_count(F.col("own")).alias("words"), F.md5(X.comparable(F.col("own"))).alias("comparable"), F.md5(X.content_key(F.col("own"))).alias("content"))


def _key():
    """What posts are told alike by; a digest stands for the words, so no whole text is shuffled to find its copies."""
    content = F.col("_content")
    return F.when((content != "") | (F.size("images") > 0), F.sha2(F.concat_ws("|", F.lower("author"), content, F.array_join("images", " ")), 256))


def _keyed(spark, sf_dir):
    items, key = feed(spark, sf_dir).withColumn("_content", X.content_key(F.col("own"))), _key()
    return items.select("doc_id", X.status_of(F.col("url")).alias("status"), F.col("doc_id").alias("pos"), key.alias("key"))


@query(feed_sql("SELECT doc_id, key IS NULL OR row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1 AS kept FROM keyed", _KEYED))
def dedupe_batch(spark, sf_dir):
    found = posts.duplicates(_keyed(spark, sf_dir), spark.createDataFrame([], "key string, status string"))
    return found.select("doc_id", (F.col("outcome") == "kept").alias("kept"))


@query(feed_sql("""
SELECT doc_id, CASE WHEN key IS NULL THEN 'kept' WHEN first IS NULL OR doc_id < first THEN 'repeats' WHEN doc_id = first THEN 'kept' ELSE 'duplicates' END AS outcome
FROM (SELECT *, min(CASE WHEN keepable THEN doc_id END) OVER (PARTITION BY key) AS first FROM
  (SELECT k.*, NOT EXISTS (SELECT 1 FROM keyed o WHERE o.doc_id % 2 = 0 AND o.key = k.key AND o.status <> k.status) AS keepable FROM keyed k))""", _KEYED))
def repeat_stored(spark, sf_dir):
    rows = _keyed(spark, sf_dir)
    return posts.duplicates(rows, rows.where("pos % 2 = 0").select("key", "status")).select("doc_id", "outcome")


@query(feed_sql("""
SELECT coalesce(t.reason, k.outcome, 'kept') AS reason, count(*) AS n FROM told t LEFT JOIN
 (SELECT doc_id, CASE WHEN key IS NULL THEN NULL WHEN first IS NULL OR doc_id < first THEN 'repeats' WHEN doc_id = first THEN NULL ELSE 'duplicates' END AS outcome FROM (SELECT *, min(CASE WHEN keepable THEN doc_id END) OVER (PARTITION BY key) AS first FROM
  (SELECT k.*, NOT EXISTS (SELECT 1 FROM keyed_all o WHERE o.doc_id % 3 = 0 AND o.key = k.key AND o.status <> k.status) AS keepable FROM keyed k))) k ON k.doc_id = t.doc_id GROUP BY 1""",
    SOURCES, f"told AS (SELECT f.doc_id, {_REASON} AS reason FROM feed f JOIN sources s ON s.name = f.source)", "admitted AS (SELECT f.* FROM feed f JOIN told t ON t.doc_id = f.doc_id WHERE t.reason IS NULL)",
    _KEYED.replace("FROM feed)", "FROM admitted)"), _KEYED.replace("keyed AS", "keyed_all AS")))
def filter_report(spark, sf_dir):
    """All that a fetch drops, by the rule that comes first; every third post is stored."""
    items = feed(spark, sf_dir).join(derived_sources(spark, sf_dir), F.col("source") == F.col("name")).withColumn("thread_reply", F.lit(False)).withColumn("_content", X.content_key(F.col("own")))
    rows = items.withColumns({"status": X.status_of(F.col("url")), "pos": F.col("doc_id")})
    stored = _keyed(spark, sf_dir).where("pos % 3 = 0").select("key", "status")
    found = posts.filtered(rows, posts.drop_reason(HIDE, F.col("source") == "@src7", ONLY), _key(), stored)
    return found.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(_n())


@query("""
SELECT conv_id, turn, CASE WHEN turn = 0 THEN false WHEN EXISTS (SELECT 1 FROM conversations r WHERE r.conv_id = c.conv_id AND r.turn = 0 AND c.conv_id % 3 <> 0) THEN true
  ELSE row_number() OVER (PARTITION BY conv_id, turn = 0 ORDER BY turn) > 1 END AS thread_reply FROM conversations c""")
def thread_collapse(spark, sf_dir):
    """A third of the conversations come without their first post's id, so only the oldest reply of these stays."""
    rows = table(spark, sf_dir, "conversations")
    root = F.concat(F.when(F.col("conv_id") % 3 == 0, "lost-").otherwise(""), F.col("conv_id").cast("string"))
    items = rows.select(
        "conv_id", "turn", F.when(F.col("turn") == 0, F.col("conv_id").cast("string")).otherwise(F.concat("conv_id", F.lit("-"), "turn")).alias("status"),
        F.when(F.col("turn") == 0, "").otherwise(root).alias("thread_root"), F.col("turn").alias("published"), F.col("turn").alias("pos"),
    )
    return posts.thread_replies(items).select("conv_id", "turn", "thread_reply")


@query(feed_sql("SELECT min(doc_id) AS doc_id, own_id FROM (SELECT doc_id, sha256(story) AS own_id FROM feed) WHERE own_id NOT IN (SELECT sha256(story) FROM feed WHERE doc_id % 3 = 0) GROUP BY own_id"))
def insert_or_ignore(spark, sf_dir):
    rows = feed(spark, sf_dir).select("doc_id", F.sha2(X.story_text(F.col("own")), 256).alias("own_id"))
    return posts.insert_or_ignore(rows, rows.where("doc_id % 3 = 0"), "own_id", "doc_id")


# -- windows of time ------------------------------------------------------------------------------


@query(feed_sql(f"SELECT doc_id FROM feed WHERE coalesce(published, fetched_at) >= TIMESTAMP '{DAY}'"))
def window_24h(spark, sf_dir):
    return posts.window_since(derived_feed(spark, sf_dir), DAY).select("doc_id")


@query(feed_sql(f"SELECT doc_id FROM feed WHERE coalesce(published, fetched_at) >= TIMESTAMP '{DAY}' AND coalesce(published, fetched_at) < TIMESTAMP '{NEXT_DAY}' AND fetched_at <= TIMESTAMP '{NEXT_DAY}'"))
def window_between(spark, sf_dir):
    return posts.window_between(derived_feed(spark, sf_dir), DAY, NEXT_DAY, NEXT_DAY).select("doc_id")


@query(feed_sql(f"SELECT doc_id FROM feed WHERE fetched_at >= TIMESTAMP '{DAY}'"))
def window_since_run(spark, sf_dir):
    return posts.window_since_run(derived_feed(spark, sf_dir), DAY).select("doc_id")


@query(feed_sql(f"""SELECT source, count(*) AS n, min(published) AS first, max(published) AS last FROM
 (SELECT source, published FROM feed WHERE published >= TIMESTAMP '{DAY}' UNION ALL SELECT source, max(published) FROM feed WHERE published < TIMESTAMP '{DAY}' GROUP BY source) GROUP BY source"""))
def post_times(spark, sf_dir):
    times = posts.post_times(derived_feed(spark, sf_dir), DAY)
    return times.select("source", F.size("times").cast("bigint").alias("n"), F.col("times")[0].alias("first"), F.element_at("times", -1).alias("last"))


@query("""SELECT event_id, coalesce(ts > coalesce(max(ts) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), TIMESTAMP '2024-01-01') + INTERVAL 2 DAY, false) AS after_silence FROM events""")
def silence_flags(spark, sf_dir):
    return posts.silence(table(spark, sf_dir, "events"), "user_id", "ts", "2 days", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).select("event_id", "after_silence")


_OLD = "coalesce(max(CASE WHEN ts < TIMESTAMP '2024-01-12' THEN 1 END) OVER (PARTITION BY user_id ORDER BY event_id % 97, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 0"


def _taken(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("pos", F.struct(F.col("event_id") % 97, "event_id"))
    return events, posts.take_while(events, "user_id", F.col("pos"), F.col("ts") < F.lit("2024-01-12 00:00:00").cast("timestamp_ntz"))


@query(f"SELECT event_id FROM (SELECT event_id, {_OLD} AS ok FROM events) WHERE ok")
def take_while_cutoff(spark, sf_dir):
    return _taken(spark, sf_dir)[1].select("event_id")


@query(f"""WITH kept AS (SELECT * FROM (SELECT event_id, user_id, {_OLD} AS ok FROM events) WHERE ok)
SELECT event_id FROM kept UNION ALL SELECT arg_min(event_id, (event_id % 97) * 10000000000 + event_id) FROM events WHERE user_id NOT IN (SELECT user_id FROM kept) GROUP BY user_id""")
def fallback_latest(spark, sf_dir):
    events, kept = _taken(spark, sf_dir)
    return posts.with_fallback(kept, events, "user_id", [F.col("pos")]).select("event_id")


@query(feed_sql(f"SELECT doc_id FROM feed WHERE fetched_at >= TIMESTAMP '{DAY}' AND (published IS NULL OR published >= TIMESTAMP '{NEXT_DAY}')"))
def retention_forget(spark, sf_dir):
    return posts.within_horizon(posts.forget(derived_feed(spark, sf_dir), DAY), NEXT_DAY).select("doc_id")


@query("SELECT key, arg_max(value, event_id) AS value FROM (SELECT user_id AS key, event_type AS value, event_id FROM events) GROUP BY key")
def meta_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), "event_id")
    return posts.upsert(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "key", "event_id").select("key", "value")


# -- stories --------------------------------------------------------------------------------------

_SETS = rf"""
worded AS (SELECT id, published, source, section, tier, list_sort(list_distinct(list_filter(regexp_extract_all(regexp_replace(lower(story), '{_URL}', ' ', 'g'), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) > 3 AND w NOT IN ({_STOP})))) AS toks FROM feed),
enough AS (SELECT *, (CASE WHEN published IS NULL THEN '1' ELSE '0' END) || coalesce(strftime(published, '%Y%m%d%H%M%S'), '') || id AS ak FROM worded WHERE len(toks) >= 5),
sets AS MATERIALIZED (SELECT toks, min(ak) AS ak, arg_min(id, ak) AS cls, len(toks) AS n FROM enough GROUP BY toks),
tokrows AS (SELECT cls, ak, n, unnest(toks) AS w FROM sets),
edges AS MATERIALIZED (SELECT a, b, c::DOUBLE / (na + nb - c) AS score, aat, bat FROM
  (SELECT x.cls AS a, y.cls AS b, any_value(x.n) AS na, any_value(y.n) AS nb, any_value(x.ak) AS aat, any_value(y.ak) AS bat, count(*) AS c FROM tokrows x JOIN tokrows y ON x.w = y.w AND x.ak < y.ak AND x.n * 0.4 <= y.n AND y.n * 0.4 <= x.n GROUP BY x.cls, y.cls)
  WHERE c >= 3 AND c::DOUBLE / (na + nb - c) >= 0.4)"""


def _round(i: int) -> str:
    return f"""s{i} AS MATERIALIZED (SELECT n.cls, CASE WHEN n.state <> 'open' THEN n.state WHEN e.led THEN 'member' WHEN NOT coalesce(e.waits, false) THEN 'leader' ELSE 'open' END AS state
 FROM s{i - 1} n LEFT JOIN (SELECT e.b AS cls, bool_or(p.state = 'leader') AS led, bool_or(p.state = 'open') AS waits FROM edges e JOIN s{i - 1} p ON p.cls = e.a GROUP BY e.b) e ON e.cls = n.cls)"""


ROUNDS = 8
_LEADERS = "s0 AS (SELECT cls, 'open' AS state FROM sets), " + ", ".join(_round(i) for i in range(1, ROUNDS + 1)) + f", lead AS (SELECT cls FROM s{ROUNDS} WHERE state = 'leader')"
_MEMBERS = """
options AS (SELECT e.b AS cls, e.a AS leader, e.aat AS lat, e.score FROM edges e JOIN lead l ON l.cls = e.a UNION ALL SELECT e.a, e.b, e.bat, e.score FROM edges e JOIN lead l ON l.cls = e.b UNION ALL SELECT l.cls, l.cls, s.ak, 1.0 FROM lead l JOIN sets s ON s.cls = l.cls),
members AS (SELECT id, source, published, section, leader FROM (SELECT m.id, m.source, m.published, m.section, o.leader, row_number() OVER (PARTITION BY m.id ORDER BY o.score DESC, o.lat) AS rn FROM enough m JOIN sets s ON s.toks = m.toks JOIN options o ON o.cls = s.cls WHERE o.lat <= m.ak) WHERE rn = 1)"""


@query(feed_sql("SELECT a, b, round(score, 9) AS score FROM edges", _SETS))
def story_pairs(spark, sf_dir):
    return stories.pairs_of(feed(spark, sf_dir)).select("a", "b", F.round("score", 9).alias("score"))


@query(feed_sql("SELECT id, leader FROM members", _SETS, _LEADERS, _MEMBERS))
def story_leaders(spark, sf_dir):
    return stories.stories(feed(spark, sf_dir)).select("id", "leader")


@query(feed_sql("SELECT leader, count(*) AS posts, count(DISTINCT source) AS sources FROM members GROUP BY leader HAVING count(DISTINCT source) >= 2", _SETS, _LEADERS, _MEMBERS))
def story_sources(spark, sf_dir):
    items = feed(spark, sf_dir)
    return stories.told_by(stories.stories(items), items)


@query(feed_sql("SELECT leader, source, id FROM (SELECT *, row_number() OVER (PARTITION BY leader, source ORDER BY published IS NULL, published, id) AS rn FROM members) WHERE rn = 1", _SETS, _LEADERS, _MEMBERS))
def story_first_by_source(spark, sf_dir):
    items = feed(spark, sf_dir)
    return stories.first_by_source(stories.stories(items), items)


@query(feed_sql("SELECT leader, bool_and(section = 'x/de') AS recap_only FROM members GROUP BY leader HAVING count(DISTINCT source) >= 2", _SETS, _LEADERS, _MEMBERS))
def recap_story_routing(spark, sf_dir):
    items = feed(spark, sf_dir)
    found = stories.stories(items).join(items.select("id", "source", "section"), "id")
    return found.groupBy("leader").agg(F.bool_and(F.col("section") == "x/de").alias("recap_only"), F.countDistinct("source").alias("k")).where("k >= 2").drop("k")


#: Ten posts each: the first is a post, three share it: whole, cut off, spaced otherwise; the others share nothing.
_SHARED = rf"""tens AS (SELECT doc_id, doc_id - doc_id % 10 AS ten, doc_id % 10 AS kind, source FROM documents),
firsts AS (SELECT t.ten, 'src' || (t.ten % 7) AS author, 'Post ' || t.ten || ' reads: ' || coalesce(d.text, '') AS text FROM (SELECT DISTINCT ten FROM tens) t JOIN documents d ON d.doc_id = t.ten),
stems AS (SELECT f.*, {_comparable("substr(text, 1, 120)")} AS stem FROM firsts f),
counted AS (SELECT s.ten, s.author, s.text, s.stem, count(CASE WHEN t.kind = 3 THEN 1 END) AS whole, count(CASE WHEN t.kind = 7 AND length(s.stem) >= 20 THEN 1 END) AS cut, count(CASE WHEN t.kind = 9 THEN 1 END) AS cased FROM stems s JOIN tens t ON t.ten = s.ten GROUP BY ALL)"""


def _sharing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ten, kind = F.col("doc_id") - F.col("doc_id") % 10, F.col("doc_id") % 10
    first = docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("ten"), F.concat(F.lit("src"), (F.col("doc_id") % 7).cast("string")).alias("_by"), F.concat(F.lit("Post "), F.col("doc_id").cast("string"), F.lit(" reads: "), F.coalesce("text", F.lit(""))).alias("_text"))
    shares = kind.isin(3, 7, 9)
    copy = F.when(kind == 7, F.concat(F.substring("_text", 1, 120), F.lit("…"))).when(kind == 9, F.replace("_text", F.lit(" "), F.lit("  \t"))).otherwise(F.col("_text"))
    return docs.select("doc_id", "source").withColumn("ten", ten).join(first, "ten").select(
        F.col("doc_id").cast("string").alias("id"), F.when(kind == 0, F.col("_by")).otherwise(F.col("source")).alias("author"), F.timestamp_add("MINUTE", F.col("doc_id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("published"),
        F.when(kind == 0, F.col("_text")).otherwise("").alias("own"), F.when(shares, F.when(kind == 9, F.concat(F.lit("@"), F.upper("_by"))).otherwise(F.col("_by"))).otherwise("").alias("retweet_of_author"), F.when(shares, copy).otherwise("").alias("retweet_of_text"),
    )


@query(feed_sql("SELECT author AS handle, CAST(whole + cut + cased AS BIGINT) AS n, CAST(ten AS VARCHAR) AS original, array_to_string(list_transform(list_filter([3, 7, 9], lambda k: CASE k WHEN 3 THEN whole WHEN 7 THEN cut ELSE cased END > 0), lambda k: CAST(ten + k AS VARCHAR)), ' ') AS ids FROM counted WHERE whole + cut + cased >= 2", _SHARED))
def shared_retweets(spark, sf_dir):
    found = stories.shared_retweets(_sharing(spark, sf_dir))
    return found.select("handle", "n", "original", F.array_join("ids", " ").alias("ids"))


@query(feed_sql("SELECT CAST(t.doc_id AS VARCHAR) AS id FROM tens t JOIN counted c ON c.ten = t.ten WHERE NOT (whole + cut + cased >= 2 AND (t.kind IN (0, 3, 9) OR (t.kind = 7 AND cut > 0)))", _SHARED))
def posts_in_no_retweet(spark, sf_dir):
    items = _sharing(spark, sf_dir)
    return stories.in_no_group(items, stories.shared_retweets(items)).select("id")


# -- names ----------------------------------------------------------------------------------------

_NAMES_STOP = ", ".join(f"'{w}'" for w in topics.STOP)
def _topics(p: str = "", where: str = "true", day: str = "CAST(published AS DATE)") -> str:
    return f"""{p}tposts AS (SELECT doc_id AS post, source AS account, section, {day} AS day, {_collapse(_no_urls(_unescape("CASE WHEN own = '' THEN retweet_of_text WHEN retweet_of_text = '' THEN own ELSE own || ' ' || retweet_of_text END")))} AS text FROM feed WHERE {where}),
{p}pieces AS (SELECT post, account, section, day, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS w, generate_subscripts(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), 1) AS ak FROM {p}tposts),
{p}tagged AS (SELECT post, account, section, day, substr(m, 2) AS w, ak - 1000000 AS ak FROM (SELECT *, unnest(regexp_extract_all(text, '\\$([A-Za-z][A-Za-z0-9]{{1,9}})(?:[^\\p{{L}}\\p{{N}}_]|$)', 0)) AS m, generate_subscripts(regexp_extract_all(text, '\\$([A-Za-z][A-Za-z0-9]{{1,9}})(?:[^\\p{{L}}\\p{{N}}_]|$)', 0), 1) AS ak FROM {p}tposts)),
{p}found0 AS (SELECT post, account, section, day, w AS raw, lower(w) AS key, upper(w) = w AS sure, ak FROM {p}pieces WHERE regexp_full_match(w, '[A-Z][A-Za-z0-9]{{2,}}') AND lower(w) NOT IN ({_NAMES_STOP})),
{p}cands AS (SELECT post, account, section, day, key, bool_or(sure) AS sure, arg_min(raw, ak + CASE WHEN sure THEN 0 ELSE 100000000 END) AS raw FROM {p}found0 GROUP BY ALL),
{p}lows AS (SELECT w AS key, count(*) AS low FROM {p}pieces WHERE regexp_full_match(w, '[a-z][a-z0-9]{{2,}}') GROUP BY w),
{p}weaks AS (SELECT key, sum(CASE WHEN sure THEN 0 ELSE 1 END) AS weak FROM {p}cands GROUP BY key),
{p}named AS (SELECT c.* FROM {p}cands c JOIN {p}weaks w ON w.key = c.key LEFT JOIN {p}lows l ON l.key = c.key WHERE c.sure OR coalesce(l.low, 0) * 4 <= w.weak),
{p}daysok AS (SELECT day FROM {p}tposts WHERE day IS NOT NULL GROUP BY day HAVING count(*) >= 100),
{p}dlows AS (SELECT day, w AS key, count(*) AS low FROM {p}pieces WHERE regexp_full_match(w, '[a-z][a-z0-9]{{2,}}') GROUP BY day, w),
{p}dweaks AS (SELECT day, key, sum(CASE WHEN sure THEN 0 ELSE 1 END) AS weak FROM {p}cands GROUP BY day, key),
{p}usual AS (SELECT c.key, count(*)::DOUBLE / (SELECT count(*) FROM {p}daysok) AS usual FROM {p}cands c JOIN {p}daysok d ON d.day = c.day JOIN {p}dweaks w ON w.key = c.key AND w.day = c.day LEFT JOIN {p}dlows l ON l.key = c.key AND l.day = c.day WHERE c.sure OR coalesce(l.low, 0) * 4 <= w.weak GROUP BY c.key)"""


_POSTS = _topics()


def _topic_posts(spark, sf_dir):
    shared = F.when(F.col("own") == "", F.col("retweet_of_text")).when(F.col("retweet_of_text") == "", F.col("own")).otherwise(F.concat("own", F.lit(" "), "retweet_of_text"))
    return feed(spark, sf_dir).select(F.col("doc_id").alias("post"), F.col("source").alias("account"), "section", F.to_date("published").alias("day"), topics.cleaned(shared).alias("text"))


@query(feed_sql("SELECT key, count(*) AS posts, count(DISTINCT account) AS sources FROM named GROUP BY key", _POSTS))
def name_candidates(spark, sf_dir):
    return topics.names(_topic_posts(spark, sf_dir)).groupBy("key").agg(_n("posts"), F.countDistinct("account").alias("sources"))


@query(feed_sql("SELECT key, round(usual, 6) AS usual FROM usual", _POSTS))
def usage_baseline(spark, sf_dir):
    rows = _topic_posts(spark, sf_dir).where("day is not null")
    return topics.usage_baseline(rows).select("key", F.round("usual", 6).alias("usual"))


# Posts of a day of the history; the window is the later half of all.
_DAY_POSTS = 120
_HALF = "(SELECT max(doc_id) // 2 FROM documents)"
_WINDOW = _topics("w", f"doc_id > {_HALF}", "NULL::DATE")
_HISTORY = _topics("h", f"published IS NOT NULL AND doc_id <= {_HALF}", f"(doc_id // {_DAY_POSTS})")
_HOT = """scored AS (SELECT n.key, n.posts, n.sources, n.posts / (1 + coalesce(u.usual, 0.0::DOUBLE)) AS score FROM (SELECT key, count(*) AS posts, count(DISTINCT account) AS sources FROM wnamed GROUP BY key) n LEFT JOIN husual u ON u.key = n.key),
hot AS (SELECT * FROM scored WHERE sources >= 3 AND posts >= 6 AND score >= 2.5 ORDER BY score DESC, posts DESC, key LIMIT 8)"""


def _hot(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(names of the later half of the feed, the hottest against the days of the half before)."""
    half = table(spark, sf_dir, "documents").agg(F.floor(F.max("doc_id") / 2).alias("half"))
    # Texts are read four times and names twice, and both are dear to make.
    placed = stories.kept(_topic_posts(spark, sf_dir)).crossJoin(F.broadcast(half))
    found = stories.kept(topics.names(placed.where("post > half").drop("day", "half")))
    before = placed.where("post <= half and day is not null").withColumn("day", F.floor(F.col("post") / _DAY_POSTS)).drop("half")
    return found, topics.hot_topics(found, topics.usage_baseline(before))


@query(feed_sql("SELECT key, posts, sources, round(score, 6) AS score FROM hot", _WINDOW, _HISTORY, _HOT))
def hot_topics(spark, sf_dir):
    return _hot(spark, sf_dir)[1].select("key", "posts", "sources", F.round("score", 6).alias("score"))


@query(feed_sql("SELECT key, section, n FROM (SELECT h.key, m.section, count(*) AS n, row_number() OVER (PARTITION BY h.key ORDER BY count(*) DESC, m.section) AS rn FROM hot h JOIN wnamed m ON m.key = h.key GROUP BY h.key, m.section) WHERE rn = 1", _WINDOW, _HISTORY, _HOT))
def topics_by_section(spark, sf_dir):
    found, hot = _hot(spark, sf_dir)
    return topics.most_common(found.join(F.broadcast(hot.select("key")), "key"), "section").select("key", "section", "n")


@query(feed_sql("SELECT key, raw, n FROM (SELECT h.key, m.raw, count(*) AS n, row_number() OVER (PARTITION BY h.key ORDER BY count(*) DESC, min(m.post)) AS rn FROM hot h JOIN wnamed m ON m.key = h.key GROUP BY h.key, m.raw) WHERE rn = 1", _WINDOW, _HISTORY, _HOT))
def topic_spelling_mode(spark, sf_dir):
    found, hot = _hot(spark, sf_dir)
    return topics.most_common(found.join(F.broadcast(hot.select("key")), "key"), "raw", first="post").select("key", "raw", "n")


# -- export, chunks, media ------------------------------------------------------------------------

_NUMBERED = f"""numbered AS (SELECT *, row_number() OVER (ORDER BY section, CASE tier WHEN 'regular' THEN 1 WHEN 'retweet' THEN 2 ELSE 3 END, source <> '{PRIORITY}', lower(source), source, published NULLS FIRST, id) AS n FROM feed WHERE tier IN ('regular', 'retweet', 'recap'))"""


def _numbered(spark, sf_dir, *columns):
    items = feed(spark, sf_dir)
    if columns:  # whole posts needn't be dealt along the order
        items = items.select(*dict.fromkeys([*columns, "id", "source", "section", "tier", "published"]))
    return export.numbered(items, F.col("source") == PRIORITY)


@query(feed_sql("SELECT n, doc_id FROM numbered", _NUMBERED))
def export_numbering(spark, sf_dir):
    return _numbered(spark, sf_dir).select("n", "doc_id")


@query(feed_sql("SELECT n, url, source, tier, grp, CAST(words AS BIGINT) AS words FROM numbered", _NUMBERED))
def export_map(spark, sf_dir):
    return _numbered(spark, sf_dir).select("n", "url", "source", "tier", "grp", "words")


_LINES = rf"""flatted AS (SELECT *, CASE WHEN tier = 'regular' THEN 400 ELSE 220 END AS lim, {_collapse(_no_urls(_unescape("CASE WHEN pure THEN retweet_of_text WHEN retweet_of_author <> '' THEN own || ' ⟪' || retweet_of_text || '⟫' ELSE own END")))} AS t FROM numbered),
headed AS (SELECT *, substr(t, 1, lim) AS head FROM flatted),
wordcut AS (SELECT *, CASE WHEN instr(head, ' ') > 0 AND regexp_extract(head, '(?s)^(.*) [^ ]*$', 1) <> '' THEN regexp_extract(head, '(?s)^(.*) [^ ]*$', 1) ELSE head END AS kept FROM headed),
lines AS (SELECT *, '[' || n || '] ' || source || ' ' || CASE WHEN retweet_of_author = '' THEN '' WHEN pure THEN 'RT@' || retweet_of_author || ' ' ELSE 'QT@' || retweet_of_author || ' ' END || CASE WHEN length(t) > lim THEN regexp_replace(kept, '[ ,;:\-–—]+$', '') || '…' ELSE t END AS line FROM wordcut)"""


def _lines(spark, sf_dir):
    return _numbered(spark, sf_dir).withColumn("line", export.line(export.lookup(export.LIMITS, F.col("tier"), 220)))


@query(feed_sql("SELECT n, line FROM lines", _NUMBERED, _LINES))
def export_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("n", "line")


@query(feed_sql(r"SELECT CAST(regexp_extract(line, '^\[(\d+)\]', 1) AS BIGINT) AS n, regexp_extract(line, '^\[\d+\] (\S+)', 1) AS source, CAST(length(line) AS BIGINT) AS chars FROM lines", _NUMBERED, _LINES))
def export_roundtrip(spark, sf_dir):
    parsed = _lines(spark, sf_dir).select("line")
    return parsed.select(F.regexp_extract("line", r"^\[(\d+)\]", 1).cast("bigint").alias("n"), F.regexp_extract("line", r"^\[\d+\] (\S+)", 1).alias("source"), F.length("line").cast("bigint").alias("chars"))


_LEVEL = "CASE WHEN grp = 'de' THEN 'low' WHEN grp = 'fr' THEN 'high' ELSE 'normal' END"


@query(feed_sql(f"""SELECT doc_id, row_number() OVER (ORDER BY pos / w, section) AS rank FROM (SELECT doc_id, section, row_number() OVER (PARTITION BY section ORDER BY turn, newest DESC NULLS LAST, source, id) AS pos, f * count(*) OVER (PARTITION BY section) AS w FROM
 (SELECT *, row_number() OVER (PARTITION BY section, source ORDER BY published DESC NULLS LAST, id) AS turn, max(published) OVER (PARTITION BY section, source) AS newest, CASE {_LEVEL} WHEN 'low' THEN 0.5::DOUBLE WHEN 'high' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS f FROM feed WHERE tier = 'media'))"""))
def rank_media(spark, sf_dir):
    level = F.when(F.col("grp") == "de", "low").when(F.col("grp") == "fr", "high").otherwise("normal")
    return export.rank_media(feed(spark, sf_dir).where("tier = 'media'"), level).select("doc_id", "rank")


@query(feed_sql("""SELECT tier, level, posts, words, greatest(20, CAST(round_even(share * words, 0) AS BIGINT)) AS target FROM (SELECT tier, CASE WHEN tier = 'recap' THEN 'normal' ELSE level END AS level, count(*) AS posts, CAST(sum(words) AS BIGINT) AS words,
 CASE tier WHEN 'regular' THEN 0.25::DOUBLE WHEN 'retweet' THEN 0.04::DOUBLE ELSE 0.16::DOUBLE END * CASE CASE WHEN tier = 'recap' THEN 'normal' ELSE level END WHEN 'high' THEN 1.5::DOUBLE WHEN 'low' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS share FROM (SELECT n.*, s.level FROM numbered n JOIN sources s ON s.name = n.source) GROUP BY 1, 2)""", _NUMBERED, SOURCES))
def chunk_targets(spark, sf_dir):
    items = _numbered(spark, sf_dir).join(derived_sources(spark, sf_dir), F.col("source") == F.col("name")).withColumn("level", F.when(F.col("tier") == "recap", "normal").otherwise(F.col("level")))
    return items.groupBy("tier", "level").agg(_n("posts"), F.sum("words").alias("words")).withColumn("target", export.target_words(F.col("tier"), F.col("level"), F.col("words")))


#: Lines of a stream packed one after another, by recursion along their place.
_PACKED = """streamed AS (SELECT n, tier, words, section, line, CASE WHEN tier = 'recap' THEN 'normal' ELSE level END AS level, CASE WHEN tier = 'recap' THEN section ELSE '' END AS stream FROM (SELECT l.*, s.level FROM lines l JOIN sources s ON s.name = l.source)),
placed AS (SELECT *, length(line) + 1 AS own, length(section) + 5 AS head, row_number() OVER (PARTITION BY tier, level, stream ORDER BY n) AS place FROM streamed),
folded AS (SELECT n, tier, level, stream, section, place, 1 AS part, own + head AS used FROM placed WHERE place = 1 UNION ALL
 SELECT p.n, p.tier, p.level, p.stream, p.section, p.place, CASE WHEN f.used + p.own + CASE WHEN p.section <> f.section THEN p.head ELSE 0 END > 13500 THEN f.part + 1 ELSE f.part END,
  CASE WHEN f.used + p.own + CASE WHEN p.section <> f.section THEN p.head ELSE 0 END > 13500 THEN p.own + p.head ELSE f.used + p.own + CASE WHEN p.section <> f.section THEN p.head ELSE 0 END END
 FROM folded f JOIN placed p ON p.tier = f.tier AND p.level = f.level AND p.stream = f.stream AND p.place = f.place + 1),
parts AS (SELECT f.tier, f.level, f.stream, f.part, count(*) AS posts, CAST(sum(p.words) AS BIGINT) AS words, min(f.n) AS first FROM folded f JOIN placed p ON p.n = f.n GROUP BY ALL),
named_parts AS (SELECT *, CASE tier WHEN 'retweet' THEN 'retweets' ELSE tier END || CASE WHEN level = 'normal' THEN '' ELSE '-' || level END || '-' || CASE WHEN nth < 10 THEN '0' ELSE '' END || nth AS chunk,
  greatest(20, CAST(round_even(CASE tier WHEN 'regular' THEN 0.25::DOUBLE WHEN 'retweet' THEN 0.04::DOUBLE ELSE 0.16::DOUBLE END * CASE level WHEN 'high' THEN 1.5::DOUBLE WHEN 'low' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * words, 0) AS BIGINT)) AS target
  FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY CASE level WHEN 'high' THEN 1 WHEN 'normal' THEN 2 ELSE 3 END, first) AS nth FROM parts))"""
_LIMITED = """SELECT *, greatest(1, CAST(ceil(max_items * CASE tier WHEN 'recap' THEN 0.5 ELSE 0.25 END) AS BIGINT)) AS min_items FROM
 (SELECT chunk, tier, level, posts, words, first, target, greatest(1, least(CAST(round_even(target::DOUBLE / CASE tier WHEN 'recap' THEN 40 ELSE 30 END, 0) AS BIGINT), CASE tier WHEN 'retweet' THEN 8 WHEN 'recap' THEN 20 ELSE 1000000000 END, posts)) AS max_items, CASE WHEN tier = 'recap' THEN 5::BIGINT END AS max_ids FROM named_parts)"""


def _chunked(spark, sf_dir):
    """(numbered posts with their stream and part, one row a part with its name and limits)."""
    levels = derived_sources(spark, sf_dir).select(F.col("name").alias("source"), "level")
    recap = F.col("tier") == "recap"
    rows = _lines(spark, sf_dir).join(levels, "source").withColumns({"level": F.when(recap, "normal").otherwise(F.col("level")), "stream": F.when(recap, F.col("section")).otherwise("")})
    packed = export.pack(rows.select("n", "id", "tier", "level", "stream", "section", "line", "words", "source"), ["tier", "level", "stream"])
    sums = packed.groupBy("tier", "level", "stream", "part").agg(_n("posts"), F.sum("words").alias("words"), F.min("n").alias("first"))
    target = export.target_words(F.col("tier"), F.col("level"), F.col("words"))
    return packed, exports.chunk_names(sums.withColumn("target", target).withColumns(export.item_limits(F.col("tier"), target, F.col("posts"))))


@query(feed_sql(_LIMITED, _NUMBERED, _LINES, SOURCES, _PACKED).replace("WITH ", "WITH RECURSIVE ", 1))
def pack_chunks(spark, sf_dir):
    return _chunked(spark, sf_dir)[1].drop("stream", "part")


_STEPS = "steps AS (SELECT k::DOUBLE / 100 AS c FROM range(10, 26) t(k)), total AS (SELECT CAST(sum(words) AS DOUBLE) AS w, count(DISTINCT section) AS s FROM numbered), lined AS (SELECT c, 0.83::DOUBLE * round_even(c * w / 30, 0) + 4 * s AS lines FROM steps, total)"


@query(feed_sql("SELECT coalesce(max(CASE WHEN lines <= (SELECT 0.2::DOUBLE * w / 30 FROM total) THEN c END), 0.1) AS compression FROM lined", _NUMBERED, _STEPS))
def choose_compression(spark, sf_dir):
    """The highest step whose summaries take a fifth of the day's lines at most."""
    total = _numbered(spark, sf_dir).agg(F.sum("words").cast("double").alias("w"), F.countDistinct("section").alias("s"))
    steps = total.withColumn("c", F.explode(F.transform(F.sequence(F.lit(10), F.lit(25)), lambda k: k.cast("double") / 100)))
    lines = F.lit(0.83) * F.bround(F.col("c") * F.col("w") / 30) + 4 * F.col("s")
    return steps.agg(F.coalesce(F.max(F.when(lines <= F.lit(0.2) * F.col("w") / 30, F.col("c"))), F.lit(0.1)).alias("compression"))


# -- verification ---------------------------------------------------------------------------------

_REPLIES = """posted AS (SELECT doc_id AS n, doc_id // 25 AS chunk, full_text AS text, grp FROM feed),
size AS (SELECT max(doc_id) + 1 AS n FROM documents),
replies AS (SELECT item_id AS item, (item_id * 75 % size.n) // 25 AS chunk, substr(text, 1, 60) AS headline, substr(text, 61) AS detail, [item_id * 75 % size.n, (item_id * 75 + 1) % size.n, item_id * 31 % size.n] AS ids FROM benchmark, size)"""


def _replies(spark, sf_dir):
    """Benchmark texts as recorded replies that cite posts of the whole feed, 25 posts a chunk."""
    i, n = F.col("item_id"), F.col("_n")
    size = table(spark, sf_dir, "documents").agg((F.max("doc_id") + 1).alias("_n"))
    items = table(spark, sf_dir, "benchmark").crossJoin(F.broadcast(size)).select(
        i.alias("item"), F.floor(i * 75 % n / 25).alias("chunk"), F.substring("text", 1, 60).alias("headline"), F.expr("substring(text, 61)").alias("detail"), F.array(i * 75 % n, (i * 75 + 1) % n, i * 31 % n).alias("ids"),
    )
    return items, derived_feed(spark, sf_dir).select(F.col("doc_id").alias("n"), F.floor(F.col("doc_id") / 25).alias("chunk"), F.col("full_text").alias("text"), "grp")


@query(feed_sql(r"""SELECT p.chunk, p.posts, coalesce(h.items, 0) AS items, coalesce(h.dup, 0) AS duplicate_headlines, coalesce(i.ids, 0) AS ids, coalesce(i.valid, 0) AS valid, round(coalesce(i.covered::DOUBLE / p.posts, 0.0), 6) AS coverage, round(coalesce(h.words, 0.0), 6) AS detail_words,
 round(coalesce(h.each, 0.0), 6) AS ids_per_item, CAST(coalesce(h.most, 0) AS BIGINT) AS max_ids, coalesce(i.cited, 0) AS cited
FROM (SELECT chunk, count(*) AS posts FROM posted GROUP BY chunk) p
LEFT JOIN (SELECT chunk, count(*) AS items, count(*) - count(DISTINCT lower(trim(headline))) AS dup, avg(len(regexp_extract_all(detail, '\S+')))::DOUBLE AS words, avg(len(ids))::DOUBLE AS each, max(len(ids)) AS most FROM cut GROUP BY chunk) h ON h.chunk = p.chunk
LEFT JOIN (SELECT r.chunk, count(*) AS ids, count(q.n) AS valid, count(DISTINCT q.n) AS covered, count(DISTINCT r.id) AS cited FROM (SELECT chunk, unnest(ids) AS id FROM cut) r LEFT JOIN posted q ON q.n = r.id AND q.chunk = r.chunk GROUP BY r.chunk) i ON i.chunk = p.chunk""",
    _REPLIES, "cut AS (SELECT item, chunk, headline, CASE chunk % 3 WHEN 0 THEN replace(detail, chr(10), '\\n') WHEN 1 THEN substr(detail, 1, 40) ELSE detail END AS detail, CASE WHEN chunk % 3 = 2 THEN ids[1:2] ELSE ids END AS ids FROM replies)"))
def chunk_stats(spark, sf_dir):
    """Replies go through their raw JSON; every third chunk's are cut off behind its last item, so they don't parse and are read as far as they go, escapes and all."""
    items, rows = _replies(spark, sf_dir)
    c = F.col("chunk")
    shaped = items.withColumns({"detail": F.when(c % 3 == 1, F.substring("detail", 1, 40)).otherwise(F.col("detail")), "ids": F.when(c % 3 == 2, F.slice("ids", 1, 2)).otherwise(F.col("ids"))})
    listed = shaped.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("item", "headline", "detail", "ids"))).alias("all"))
    whole = F.to_json(F.struct(F.transform("all", lambda x: F.struct(x["headline"].alias("headline"), x["detail"].alias("detail"), x["ids"].alias("ids"))).alias("items")))
    raw = F.when(c % 3 == 0, F.expr("substring(raw, 1, length(raw) - 2)")).otherwise(F.concat(F.lit("<think>so</think>```json\n"), "raw", F.lit("\n```")))
    replies = listed.select("chunk", whole.alias("raw")).withColumn("raw", raw)
    return verify.chunk_stats(verify.reply_items(replies), rows)


@query(feed_sql("SELECT r.item, CAST(count(DISTINCT q.n) AS BIGINT) AS valid, count(DISTINCT q.n) > 0 AS shown FROM replies r LEFT JOIN posted q ON list_contains(r.ids, q.n) AND q.chunk = r.chunk GROUP BY r.item", _REPLIES))
def reply_validity(spark, sf_dir):
    items, rows = _replies(spark, sf_dir)
    cited = items.select("item", "chunk", F.explode("ids").alias("n")).join(rows.select("n", "chunk").withColumn("_ok", F.col("n")), ["n", "chunk"], "left")
    return cited.groupBy("item").agg(F.countDistinct("_ok").alias("valid")).withColumn("shown", F.col("valid") > 0)


_MIDDLE = """list_filter(list_transform({p}, lambda w, i: CASE WHEN i > 1 AND NOT regexp_matches({p}[i - 1], '[.!?]$') THEN trim(w, '.,;:!?()[]"''“”‘’') ELSE '' END), lambda w: regexp_full_match(w, '[A-Z][a-z]{{3,}}'))"""
_FACTS = rf"""evidence AS (SELECT r.item, string_agg(p.text, ' ' ORDER BY p.text) AS cited FROM (SELECT item, unnest(ids) AS n FROM marked) r JOIN posted p ON p.n = r.n GROUP BY r.item),
facts AS (SELECT m.item, coalesce(e.cited, '') AS cited, lower(coalesce(e.cited, '')) AS low, replace(coalesce(e.cited, ''), ',', '') AS plain, headline || ' ' || detail AS t,
  list_filter(string_split_regex(headline, '\s+'), lambda w: w <> '') AS hw, list_filter(string_split_regex(detail, '\s+'), lambda w: w <> '') AS dw FROM marked m LEFT JOIN evidence e ON e.item = m.item),
told AS (SELECT item, cited, low, plain, list_transform(regexp_extract_all(t, '\d[\d,]*(?:\.\d+)?'), lambda x: replace(x, ',', '')) AS numbers, regexp_extract_all(t, '@\w{{2,}}') AS marks,
  list_filter(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,}}')) AS acronyms, list_concat({_MIDDLE.format(p="hw")}, {_MIDDLE.format(p="dw")}) AS capitals FROM facts)"""


@query(feed_sql(r"""SELECT item, CAST(len(numbers) + len(marks) AS BIGINT) AS facts,
 CAST(len(list_filter(numbers, lambda x: NOT regexp_matches(plain, '(^|[^0-9.])' || replace(x, '.', '\.') || '($|[^0-9])'))) + len(list_filter(marks, lambda x: NOT contains(low, lower(x)))) AS BIGINT) AS unsupported_facts,
 CAST(len(acronyms) + len(capitals) AS BIGINT) AS names, CAST(len(list_filter(acronyms, lambda x: NOT contains(low, lower(x)))) + len(list_filter(capitals, lambda x: NOT contains(low, substr(lower(x), 1, 4)))) AS BIGINT) AS unsupported_names, cited = '' AS uncited FROM told""",
    _REPLIES, "marked AS (SELECT item, headline, detail || ' It cost ' || (item * 7) || ',' || (item % 10) || '00.5 says @user' || item || ' of the EU' AS detail, CASE WHEN item % 9 = 0 THEN [-1::BIGINT] ELSE ids END AS ids FROM replies)", _FACTS))
def support_facts(spark, sf_dir):
    """Replies with a figure, a handle and an acronym added; every ninth cites nothing."""
    items, rows = _replies(spark, sf_dir)
    i = F.col("item")
    said = F.concat("detail", F.lit(" It cost "), (i * 7).cast("string"), F.lit(","), (i % 10).cast("string"), F.lit("00.5 says @user"), i.cast("string"), F.lit(" of the EU"))
    cited = F.when(i % 9 == 0, F.array(F.lit(-1).cast("bigint"))).otherwise(F.col("ids"))
    return verify.support(items.select("item", "headline", said.alias("detail"), cited.alias("ids")), rows)


@query(feed_sql("SELECT CAST(f.doc_id AS BIGINT) AS doc_id FROM feed f WHERE f.doc_id NOT IN (SELECT unnest(ids) FROM replies)", _REPLIES))
def uncovered_posts(spark, sf_dir):
    items, rows = _replies(spark, sf_dir)
    return rows.join(items.select(F.explode("ids").alias("n")), "n", "left_anti").select(F.col("n").alias("doc_id"))


@query(feed_sql("SELECT item, grp FROM (SELECT r.item, f.grp, row_number() OVER (PARTITION BY r.item ORDER BY count(*) DESC, f.grp) AS rn FROM (SELECT item, unnest(ids) AS n FROM replies) r JOIN feed f ON f.doc_id = r.n GROUP BY r.item, f.grp) WHERE rn = 1", _REPLIES))
def section_of_majority(spark, sf_dir):
    items, _ = _replies(spark, sf_dir)
    groups = derived_feed(spark, sf_dir).select(F.col("doc_id").alias("n"), "grp")
    counts = items.select("item", F.explode("ids").alias("n")).join(groups, "n").groupBy("item", "grp").agg(_n())
    w = Window.partitionBy("item").orderBy(F.desc("n"), "grp")
    return counts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("item", "grp")


@query("""WITH sized AS (SELECT source, sum(length(text)) AS chars FROM documents GROUP BY source),
runs AS (SELECT source, chars, CASE WHEN CAST(substr(source, 4) AS INT) % 4 = 0 THEN chars // 8 ELSE chars // 4 END AS tokens FROM sized),
rated AS (SELECT source, chars::DOUBLE / tokens AS ratio FROM runs WHERE tokens > 0 AND chars >= 0.6 * (SELECT max(chars) FROM runs WHERE tokens > 0))
SELECT source, round(ratio, 6) AS ratio FROM rated WHERE (SELECT count(*) FROM rated) >= 3 AND ratio > 1.3::DOUBLE * (SELECT median(ratio) FROM rated)""")
def truncation_suspects(spark, sf_dir):
    """A source's documents as one prompt; of every fourth half the tokens went missing."""
    sized = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.length("text")).alias("chars"))
    lost = F.substring("source", 4, 10).cast("int") % 4 == 0
    runs = sized.withColumn("tokens", F.when(lost, F.floor(F.col("chars") / 8)).otherwise(F.floor(F.col("chars") / 4)))
    return verify.truncation_suspects(runs).select("source", F.round("ratio", 6).alias("ratio"))


@query(feed_sql("SELECT tier, count(*) AS posts, count(c.n) AS cited, round(count(c.n)::DOUBLE / count(*), 6) AS share FROM feed f LEFT JOIN (SELECT DISTINCT unnest(ids) AS n FROM replies) c ON c.n = f.doc_id GROUP BY tier", _REPLIES))
def coverage_by_tier(spark, sf_dir):
    items, _ = _replies(spark, sf_dir)
    cited = items.select(F.explode("ids").alias("doc_id")).distinct().withColumn("_c", F.lit(1))
    found = feed(spark, sf_dir).join(cited, "doc_id", "left").groupBy("tier").agg(_n("posts"), F.count("_c").alias("cited"))
    return found.withColumn("share", F.round(F.col("cited").cast("double") / F.col("posts"), 6))


@query(feed_sql(r"SELECT tier, count(*) AS items, CAST(sum(len(regexp_extract_all(body, '\n')) + 1) AS BIGINT) AS lines, round(CAST(sum(len(regexp_extract_all(body, '\n')) + 1) AS DOUBLE) + sum(n_images) * 4 * 40 / 60::DOUBLE, 6) AS length FROM feed GROUP BY tier"))
def brief_lengths(spark, sf_dir):
    """Lines, and pictures at what they weigh in lines."""
    body = X.display_body(F.col("own"))
    rows = feed(spark, sf_dir).select("tier", (F.regexp_count(body, F.lit("\n")) + 1).alias("l"), F.size("images").alias("i"))
    return rows.groupBy("tier").agg(_n("items"), F.sum("l").alias("lines"), F.round(F.sum("l").cast("double") + F.sum("i") * 4 * 40 / F.lit(60.0), 6).alias("length"))


# -- reading later --------------------------------------------------------------------------------


_LINKED = r"""linked AS (SELECT doc_id, 'See https://site' || (doc_id % 3) || '.example.org/a_(b' || doc_id || ')). Then <http://x.com/u/status/' || doc_id || '> and [it](https://localhost/x) or https://sub.twitter.com/i! Again https://site' || (doc_id % 3) || '.example.org/a_(b' || doc_id || ')#part, (https://news.example.net/?q=' || doc_id || '!). ' || coalesce(text, '') AS text FROM documents)"""


def _linked(spark, sf_dir):
    """Documents that open with links of every kind."""
    i = F.col("doc_id").cast("string")
    site = F.concat(F.lit("https://site"), (F.col("doc_id") % 3).cast("string"), F.lit(".example.org/a_(b"), i, F.lit(")"))
    lead = F.concat(F.lit("See "), site, F.lit("). Then <http://x.com/u/status/"), i, F.lit("> and [it](https://localhost/x) or https://sub.twitter.com/i! Again "), site, F.lit("#part, (https://news.example.net/?q="), i, F.lit("!). "))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(lead, F.coalesce("text", F.lit(""))).alias("text"))


@query(rf"""WITH {_LINKED} SELECT doc_id, 'https://site' || (doc_id % 3) || '.example.org/a_(b' || doc_id || ')' AS url, 0::BIGINT AS pos FROM linked UNION ALL
SELECT doc_id, 'https://news.example.net/?q=' || doc_id, 2::BIGINT FROM linked""".replace("2::BIGINT", "2::BIGINT"))
def link_extract(spark, sf_dir):
    return reading.links(_linked(spark, sf_dir), "doc_id", F.col("text"))


_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|svg)\b.*?</(?:script|style|svg)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g')"""
_CLEANED = rf"""trim(regexp_replace(regexp_replace({_CLEAN}, '[ \t]+', ' ', 'g'), ' ?\n(?: ?\n)+ ?', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(13) || chr(9))"""


@query(f"SELECT page_id, sha256({_CLEANED}) AS digest FROM pages")
def clean_page(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(X.clean_page(F.col("html")), 256).alias("digest"))


@query(rf"SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#\s]+)', 1)) AS host, CAST(len(regexp_extract_all({_CLEANED}, '\S+')) AS BIGINT) AS words, len(regexp_extract_all({_CLEANED}, '\S+')) < 100 AS short FROM pages")
def page_word_counts(spark, sf_dir):
    words = F.regexp_count(X.clean_page(F.col("html")), F.lit(r"\S+")).cast("bigint")
    return table(spark, sf_dir, "pages").select("page_id", reading.host(F.col("url")).alias("host"), words.alias("words"), (words < 100).alias("short"))


def _chain_posts(spark, sf_dir):
    """Turns as posts; a turn replies to the one before, and every fifth to the one before that."""
    up = F.when(F.col("turn") % 5 == 4, F.col("turn") - 2).otherwise(F.col("turn") - 1)
    at = lambda t: F.col("conv_id") * 1000 + t
    return table(spark, sf_dir, "conversations").select(at(F.col("turn")).alias("id"), F.when(F.col("turn") > 0, at(up)).alias("parent"), F.lit("a").alias("author"))


@query("""WITH RECURSIVE p AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - CASE WHEN turn % 5 = 4 THEN 2 ELSE 1 END END AS parent FROM conversations),
nxt AS (SELECT parent, min(id) AS id FROM p WHERE parent IS NOT NULL GROUP BY parent),
chain AS (SELECT id AS root, id, 1 AS depth FROM p WHERE parent IS NULL UNION ALL SELECT c.root, n.id, c.depth + 1 FROM chain c JOIN nxt n ON n.parent = c.id WHERE c.depth < 200)
SELECT root, id, CAST(depth AS BIGINT) AS depth FROM chain""")
def self_chain(spark, sf_dir):
    return reading.self_chain(_chain_posts(spark, sf_dir))


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'article' WHEN length(text) > 280 THEN 'long' ELSE 'post' END AS kind FROM documents""")
def classify_links(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", reading.classify(F.col("text"), F.lit(1), F.col("doc_id") % 11 == 0).alias("kind"))


@query(r"""WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '\S+'))::DOUBLE AS n FROM documents), s AS (SELECT doc_id, n, greatest(60, least(400, CAST(round_even(n * 0.2::DOUBLE, 0) AS BIGINT))) AS size FROM w)
SELECT doc_id, size, greatest(3, least(10, CAST(round_even(n / 150, 0) AS BIGINT))) AS points, greatest(20, least(40, CAST(round_even(size * 0.25::DOUBLE, 0) AS BIGINT))) AS short FROM s""")
def summary_budget(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in reading.summary_budget(F.regexp_count("text", F.lit(r"\S+"))).items()])


_OUTCOME = """SELECT doc_id, CASE WHEN key IS NULL THEN 'kept' WHEN first IS NULL OR doc_id < first THEN 'repeats' WHEN doc_id = first THEN 'kept' ELSE 'duplicates' END AS outcome
FROM (SELECT *, min(CASE WHEN keepable THEN doc_id END) OVER (PARTITION BY key) AS first FROM
  (SELECT k.*, NOT EXISTS (SELECT 1 FROM keyed o WHERE o.doc_id % 2 = 0 AND o.key = k.key AND o.doc_id <> k.doc_id) AS keepable FROM keyed k))"""


@query(f"""WITH keyed AS (SELECT doc_id, CASE WHEN words <> '' OR n > 0 THEN source || '|' || words || '|' || CASE WHEN n = 0 THEN '' WHEN doc_id % 7 = 1 THEN 'u' || doc_id ELSE 'd' || doc_id % 5 || '/' || n END END AS key
 FROM (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 'look' WHEN doc_id % 11 = 0 THEN '' ELSE coalesce(text, '') END AS words, doc_id % 4 AS n FROM documents)) {_OUTCOME}""")
def picture_duplicates(spark, sf_dir):
    """Posts told alike by words and the fingerprints of their pictures, every second one stored; of some pictures no fingerprint is known."""
    i, docs = F.col("doc_id"), table(spark, sf_dir, "documents")
    words = F.when(i % 3 == 0, "look").when(i % 11 == 0, "").otherwise(F.coalesce("text", F.lit("")))
    shown = F.transform(F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), 1, (i % 4).cast("int")), lambda k: F.concat(F.lit("https://pic/"), i.cast("string"), F.lit("/"), k.cast("string")))
    told = F.when(words != "", F.sha2(F.concat_ws("|", "source", words), 256)).otherwise(F.when(i % 4 > 0, F.sha2("source", 256)))
    rows = docs.select(i.alias("pos"), i.cast("string").alias("status"), told.alias("words"), shown.alias("images"))

    def look_up(urls):
        doc, k = F.split_part("url", F.lit("/"), F.lit(4)).cast("bigint"), F.split_part("url", F.lit("/"), F.lit(5))
        return urls.where(doc % 7 != 1).select("url", F.md5(F.concat_ws("/", doc % 5, k)).alias("digest"))

    new, old = pictures.told_apart(rows, rows.where("pos % 2 = 0"), look_up)
    return posts.duplicates(new, old.select("key", "status")).select(F.col("pos").alias("doc_id"), "outcome")


@query(feed_sql(f"""SELECT CAST(sum(n) AS BIGINT) AS rows, CASE WHEN count(*) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY block)) END AS digest FROM
 (SELECT block, count(*) AS n, sha256(string_agg(h, '' ORDER BY rk)) AS h FROM (SELECT rk, (rk - 1) // 64 AS block, sha256(id || '|' || tier || '|' || words || '|' || own) AS h FROM
  (SELECT *, row_number() OVER (ORDER BY published, doc_id) AS rk FROM feed WHERE published >= TIMESTAMP '{FROZEN}' AND published < TIMESTAMP '{NEXT_DAY}')) GROUP BY block)"""))
def frozen_digest(spark, sf_dir):
    """One hash of the posts of a frozen window, in order."""
    window = feed(spark, sf_dir).where((F.col("published") >= F.lit(FROZEN).cast("timestamp_ntz")) & (F.col("published") < F.lit(NEXT_DAY).cast("timestamp_ntz")))
    return numbering.content_digest(window, [F.col("published"), F.col("doc_id")], F.concat_ws("|", "id", "tier", F.col("words").cast("string"), "own"), fan=64)


@query(feed_sql(f"""SELECT CAST(fetched_at AS DATE) AS day, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS letters FROM
 (SELECT fetched_at, CASE WHEN doc_id % 9 = 0 THEN full_text || ' again' ELSE full_text END AS text FROM base WHERE fetched_at IS NULL OR fetched_at >= TIMESTAMP '{FROZEN}') GROUP BY 1"""))
def stored_by_day(spark, sf_dir):
    """A store by day after two inserts of the same posts, a replacement of every ninth, and forgetting what is old."""
    rows = derived_feed(spark, sf_dir).select("doc_id", "id", F.col("full_text").alias("text"), "fetched_at")
    path = feeds.store_of(spark)
    store.add_items(rows.where("doc_id % 2 = 0"), path)
    store.add_items(rows, path)
    store.replace_items(rows.where("doc_id % 9 = 0").withColumn("text", F.concat("text", F.lit(" again"))), path)
    store.forget(spark, path, FROZEN)
    store.compact(spark, path, 1)
    return store.opened(spark, path).groupBy("day").agg(_n(), F.sum(F.length("text")).cast("bigint").alias("letters"))


# -- streams --------------------------------------------------------------------------------------


def _stream(spark, sf_dir, build, mode="append"):
    events = table(spark, sf_dir, "events")
    rows = feeds.read_items(spark, f"{sf_dir}/events.parquet*", events.schema)
    return feeds.run_once(build(rows.withColumn("ts", F.col("ts").cast("timestamp"))), mode)


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, sf_dir):
    found = _stream(spark, sf_dir, lambda rows: feeds.daily_counts(rows, "ts", "event_type"), "complete")
    return found.select(F.to_date("window.start").alias("day"), "event_type", "n")


@query("SELECT event_id, user_id FROM events")
def stream_dedupe(spark, sf_dir):
    """Every event is sent twice and let in once."""
    twice = lambda rows: rows.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return _stream(spark, sf_dir, lambda rows: feeds.first_sightings(twice(rows), "event_id", "ts")).select("event_id", "user_id")


@query("""SELECT user_id, count(*) AS n, min(ts) AS first, max(ts) AS last FROM (SELECT user_id, ts, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
 FROM (SELECT user_id, ts, event_id, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 DAY, false) AS gap FROM events)) GROUP BY user_id, s""")
def stream_sessions(spark, sf_dir):
    """Runs of a user's events without a silence of two days."""
    found = _stream(spark, sf_dir, lambda rows: feeds.sessions(rows, "ts", "user_id", "2 days"), "complete")
    return found.select("user_id", "n", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first", "last")])


@query("""SELECT event_id, user_id, coalesce(ts > coalesce(max(ts) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), TIMESTAMP '2024-01-01') + INTERVAL 2 DAY, false) AS after_silence FROM events""")
def stream_silence(spark, sf_dir):
    """Events that come in three runs of a stream, every seventh two days late, flagged as ``silence_flags`` does; a row of the far future lets the last ones out."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user"), F.col("event_id").cast("string").alias("event"), F.col("ts").cast("timestamp").alias("ts"))
    days = F.datediff("ts", F.lit("2024-01-01").cast("date")) + F.when(F.col("event").cast("bigint") % 7 == 0, 2).otherwise(0)
    folder = feeds.store_of(spark)
    last = spark.sql("select '' as user, '' as event, timestamp'2100-01-01' as ts")
    for part in (events.where(days < 10), events.where(days.between(10, 19)), events.where(days >= 20), last):
        part.write.mode("append").parquet(f"{folder}/in")
        rows = feeds.read_items(spark, f"{folder}/in", events.schema)
        flagged = feeds.run_once(silence.silence_stream(rows, "user", "ts", "event", "2 days", "3 days", start="2024-01-01"), folder=f"{folder}/out")
    return flagged.select(F.col("event").cast("bigint").alias("event_id"), F.col("user").cast("bigint").alias("user_id"), "after_silence")


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def stream_append_new(spark, sf_dir):
    """The first event of each user, by a writer that adds what its store lacks, run twice over all events."""
    events = table(spark, sf_dir, "events")
    store = feeds.store_of(spark)
    for _ in range(2):
        rows = feeds.read_items(spark, f"{sf_dir}/events.parquet*", events.schema)
        feeds.run_into(rows.select("user_id", "event_id"), feeds.append_new(store, "user_id", "event_id"))
    return spark.read.parquet(store)


from feedloom import queries_brief, queries_reading  # noqa: E402, F401 - they register themselves
