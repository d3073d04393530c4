"""Registered queries of briefs, runs and languages, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import text as X
from feedloom.operators import brief, documents, export, language, posts, render, runs, stories
from feedloom.queries import (
    _LEADERS, _LINES, _MEMBERS, _NUMBERED, _PACKED, _REPLIES, _SETS, PRIORITY, SOURCES, _chunked, _lines, _n, _no_urls, _numbered, _replies, feed, feed_sql, query,
)
from feedloom.sources import exports
from feedloom.sources.feed import derived_feed, derived_sources, table

# -- replies --------------------------------------------------------------------------------------

#: Every reply item comes four times: as it is, with its headline again, told anew of the same posts, and empty.
_TOLD = """variants(k) AS (VALUES (0), (1), (2), (3)),
told AS (SELECT chunk, item * 4 + k AS item, CASE WHEN k = 1 AND item % 2 = 0 THEN upper(substr(headline, 1, 1)) || substr(headline, 2) || '!' WHEN k = 3 THEN ' ' ELSE 'No ' || k || ' ' || headline END AS headline,
  CASE WHEN k = 3 THEN '' ELSE detail END AS detail, CASE WHEN k = 1 THEN [ids[1], ids[2], ids[1], -5] ELSE ids END AS ids, item % 2 = 0 AND k = 0 AS plain, headline AS whole FROM replies, variants),
items AS (SELECT chunk, item, CASE WHEN plain THEN whole ELSE headline END AS headline, detail, ids FROM told),
flat AS (SELECT DISTINCT i.chunk, i.item, u.n FROM items i, unnest(i.ids) AS u(n)),
real AS (SELECT f.chunk, f.item, p.n, p.grp FROM flat f JOIN posted p ON p.n = f.n AND p.chunk = f.chunk),
sets AS (SELECT chunk, item, list_sort(list(n)) AS ids FROM real GROUP BY ALL),
rows AS (SELECT i.chunk, i.item, s.ids, s.ids IS NOT NULL AND (trim(headline) <> '' OR trim(detail) <> '') AS valid, array_to_string(regexp_extract_all(lower(headline), '[\\p{L}\\p{N}_]+'), ' ') AS head,
  row_number() OVER (PARTITION BY i.chunk ORDER BY i.item) AS place FROM items i LEFT JOIN sets s ON s.chunk = i.chunk AND s.item = i.item),
looping AS (SELECT chunk, count(DISTINCT nullif(head, '')) < count(nullif(head, '')) AS loops FROM rows GROUP BY chunk),
fold AS (SELECT r.chunk, r.item, r.place, CASE WHEN r.valid THEN 'kept' ELSE 'dropped' END AS outcome, CASE WHEN r.valid AND r.head <> '' THEN [r.head] ELSE [] END AS heads, CASE WHEN r.valid THEN [r.ids] ELSE [] END AS seen FROM rows r WHERE r.place = 1
 UNION ALL SELECT chunk, item, place, outcome, CASE WHEN outcome = 'kept' AND head <> '' THEN list_append(heads, head) ELSE heads END, CASE WHEN outcome = 'kept' THEN list_append(seen, ids) ELSE seen END FROM
 (SELECT r.chunk, r.item, r.place, r.head, r.ids, f.heads, f.seen, CASE WHEN NOT r.valid THEN 'dropped' WHEN list_contains(f.heads, r.head) OR (l.loops AND list_contains(f.seen, r.ids)) THEN 'repeat' ELSE 'kept' END AS outcome
  FROM fold f JOIN rows r ON r.chunk = f.chunk AND r.place = f.place + 1 JOIN looping l ON l.chunk = r.chunk)),
ranks AS (SELECT DISTINCT grp, CASE WHEN grp = 'de' THEN 3 WHEN grp = 'fr' THEN 0 WHEN grp = 'es' THEN 2 ELSE 1 END AS rank FROM posted),
filed AS (SELECT chunk, item, grp FROM (SELECT r.chunk, r.item, r.grp, row_number() OVER (PARTITION BY r.chunk, r.item ORDER BY count(*) DESC, k.rank, r.grp) AS rn FROM real r JOIN ranks k ON k.grp = r.grp GROUP BY r.chunk, r.item, r.grp, k.rank) WHERE rn = 1),
hot AS (SELECT DISTINCT chunk, item FROM (SELECT chunk, item, n // 3 AS story FROM real GROUP BY chunk, item, n // 3 HAVING count(*) >= 2)),
outcomes AS (SELECT f.chunk, f.item, f.outcome, s.ids, g.grp, h.item IS NOT NULL AS trending FROM fold f LEFT JOIN sets s ON s.chunk = f.chunk AND s.item = f.item LEFT JOIN filed g ON g.chunk = f.chunk AND g.item = f.item LEFT JOIN hot h ON h.chunk = f.chunk AND h.item = f.item)"""


def _level(grp):
    return F.when(grp == "fr", "high").when(grp == "es", "low").otherwise("normal")


def _outcomes(spark, sf_dir):
    """Replies that say things again; three posts in a row are one story."""
    replies, rows = _replies(spark, sf_dir)
    k = F.col("k")
    again = F.concat(F.upper(F.substring("headline", 1, 1)), F.expr("substring(headline, 2)"), F.lit("!"))
    head = F.when((k == 1) & (F.col("item") % 2 == 0), again).when(k == 3, " ").when((k == 0) & (F.col("item") % 2 == 0), F.col("headline")).otherwise(F.concat(F.lit("No "), k.cast("string"), F.lit(" "), "headline"))
    ids = F.when(k == 1, F.array(F.col("ids")[0], F.col("ids")[1], F.col("ids")[0], F.lit(-5).cast("bigint"))).otherwise(F.col("ids"))
    told = replies.withColumn("k", F.explode(F.array(*map(F.lit, range(4))))).select("chunk", (F.col("item") * 4 + k).alias("item"), head.alias("headline"), F.when(k == 3, "").otherwise(F.col("detail")).alias("detail"), ids.alias("ids"))
    groups = rows.select("grp").distinct().withColumn("rank", brief.group_rank(_level(F.col("grp")), F.col("grp") == "de"))
    return told, brief.summary_items(told, rows, rows.select(F.floor(F.col("n") / 3).alias("story"), "n"), groups)


def _told_sql(body: str, *ctes: str) -> str:
    return feed_sql(body, _REPLIES, _TOLD, *ctes).replace("WITH ", "WITH RECURSIVE ", 1)


@query(_told_sql("SELECT chunk, item, outcome, grp, trending, array_to_string(list_transform(ids, lambda x: CAST(x AS VARCHAR)), ' ') AS ids FROM outcomes"))
def summary_items(spark, sf_dir):
    found = _outcomes(spark, sf_dir)[1]
    listed = F.array_join(F.array_sort("ids").cast("array<string>"), " ")
    return found.select("chunk", "item", "outcome", "grp", "trending", F.when(F.size("ids") > 0, listed).alias("ids"))


@query(_told_sql("""SELECT section, chunk, item, place, accounts FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY chunk, item) AS place, count(*) OVER (PARTITION BY section) AS bullets FROM kept) k
 JOIN (SELECT r.chunk, r.item, count(DISTINCT f.source) AS accounts FROM real r JOIN feed f ON f.doc_id = r.n GROUP BY ALL) a USING (chunk, item) WHERE bullets >= 3 AND place <= 60""", "kept AS (SELECT chunk, item, coalesce(grp, '') AS section FROM outcomes WHERE outcome = 'kept')"))
def section_bullets(spark, sf_dir):
    kept = _outcomes(spark, sf_dir)[1].where("outcome = 'kept'").select("chunk", "item", "ids", F.coalesce("grp", F.lit("")).alias("section"))
    return brief.section_bullets(kept, derived_feed(spark, sf_dir).select(F.col("doc_id").alias("n"), "source"))


@query(_told_sql("SELECT chunk, item, CAST(len(ids[1:most]) AS BIGINT) AS shown, CAST(greatest(0, len(ids) - most) AS BIGINT) AS more FROM (SELECT o.chunk, o.item, list_concat(o.ids, range(10000000, 10000000 + o.item % 7)) AS ids, CASE WHEN grp = 'de' THEN 5 ELSE 4 END AS most FROM outcomes o WHERE outcome = 'kept')"))
def cited_posts(spark, sf_dir):
    """Kept bullets with up to six more posts each."""
    kept = _outcomes(spark, sf_dir)[1].where("outcome = 'kept'")
    more = F.when(F.col("item") % 7 > 0, F.sequence(F.lit(1), (F.col("item") % 7).cast("int"))).otherwise(F.array().cast("array<int>")).cast("array<bigint>")
    parts = brief.cites(F.concat("ids", more), F.coalesce(F.col("grp") == "de", F.lit(False)))
    return kept.select("chunk", "item", F.size(parts["shown"]).cast("bigint").alias("shown"), parts["more"].alias("more"))


@query(feed_sql("SELECT section, grp, items, row_number() OVER (ORDER BY CASE WHEN grp = 'de' THEN 3 WHEN grp = 'fr' THEN 0 WHEN grp = 'es' THEN 2 ELSE 1 END, section) AS place FROM (SELECT section, grp, count(*) AS items FROM feed GROUP BY ALL)"))
def section_order(spark, sf_dir):
    """Sections as a brief has them: by importance, recap groups last."""
    from pyspark.sql.window import Window

    found = feed(spark, sf_dir).groupBy("section", "grp").agg(_n("items"))
    order = Window.orderBy(brief.group_rank(_level(F.col("grp")), F.col("grp") == "de"), "section")
    return found.withColumn("place", F.row_number().over(order))


# -- sizes ----------------------------------------------------------------------------------------

_MD = r"""'# ' || coalesce(text, '') || chr(10) || '![a *b*](https://pic/' || doc_id || ') <!-- item:' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) || ' --> <b>bold</b> [some words](https://x.com/' || doc_id || ') -- https://t.co/x ***' || chr(10) || '<!-- item:' || substr(sha256(CAST(doc_id // 2 AS VARCHAR)), 1, 16) || ' -->'"""


def _markdown(spark, sf_dir):
    """Documents as pages with a picture, links, marks and tags."""
    i = F.col("doc_id").cast("string")
    mark = lambda c: F.concat(F.lit("<!-- item:"), F.substring(F.sha2(c, 256), 1, 16), F.lit(" -->"))
    head = F.concat(F.lit("# "), F.coalesce("text", F.lit("")), F.lit("\n![a *b*](https://pic/"), i, F.lit(") "))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(head, mark(i), F.lit(" <b>bold</b> [some words](https://x.com/"), i, F.lit(") -- https://t.co/x ***\n"), mark(F.floor(F.col("doc_id") / 2).cast("string"))).alias("md"))


@query(rf"""WITH shown AS (SELECT doc_id, {_MD} AS md FROM documents)
SELECT doc_id, CAST(len(list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>\n]*>', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), 'https?://\S+', ' ', 'g'), '[\s\p{{Z}}]+'), lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]'))) AS BIGINT) AS words,
 CAST(len(regexp_extract_all(md, '!\[[^\]]*\]\([^)]*\)')) AS BIGINT) AS images FROM shown""")
def measure_markdown(spark, sf_dir):
    return _markdown(spark, sf_dir).select("doc_id", *[c.alias(k) for k, c in brief.measure(F.col("md")).items()])


@query(rf"WITH shown AS (SELECT doc_id, {_MD} AS md FROM documents), found AS (SELECT doc_id, list_distinct(regexp_extract_all(md, '<!-- item:([0-9a-f]+) -->', 1)) AS d, regexp_extract_all(md, '<!-- item:([0-9a-f]+) -->', 1) AS l FROM shown) SELECT doc_id, id, CAST(CASE WHEN id = l[1] THEN 0 ELSE 1 END AS INT) AS pos FROM (SELECT doc_id, l, unnest(d) AS id FROM found)")
def item_ids(spark, sf_dir):
    return exports.item_ids(_markdown(spark, sf_dir), "doc_id", F.col("md"))


@query(feed_sql("""SELECT doc_id, lines, images, CASE WHEN images <= 4 THEN images ELSE 1 END AS picture_lines, CASE WHEN images <= 4 THEN images ELSE 0 END AS pictures,
 CASE WHEN lines >= 100 THEN '~' || CAST(CAST(round_even(lines / 10.0, 0) * 10 AS BIGINT) AS VARCHAR) ELSE CAST(lines AS VARCHAR) END || CASE WHEN lines = 1 THEN ' line' ELSE ' lines' END || CASE WHEN images > 0 THEN ' · ' || images || CASE WHEN images = 1 THEN ' picture' ELSE ' pictures' END ELSE '' END AS size
 FROM (SELECT doc_id, CAST(words AS BIGINT) + 1 AS lines, CAST(n_images AS INT) AS images FROM feed)"""))
def size_lines(spark, sf_dir):
    lines, images = F.col("words") + 1, F.size("images")
    return feed(spark, sf_dir).select("doc_id", lines.alias("lines"), images.alias("images"), brief.picture_lines(images).alias("picture_lines"), brief.pictures_shown(images).alias("pictures"), brief.size_line(lines, images).alias("size"))


@query("""SELECT event_id, strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%d') || '-' || lower(regexp_replace(strftime(ts + INTERVAL 2 HOUR, '%I%p'), '^0', '')) || CASE event_id % 3 WHEN 0 THEN '-24h' WHEN 1 THEN '-lastrun' ELSE '' END AS stamp FROM events""")
def brief_stamps(spark, sf_dir):
    header = F.concat(F.lit("# Export — "), F.when(F.col("event_id") % 3 == 0, "(past 24h)").when(F.col("event_id") % 3 == 1, "(since last run)").otherwise("(frozen)"), F.lit("\n(past 24h)"))
    return table(spark, sf_dir, "events").select("event_id", brief.stamp(F.col("ts").cast("timestamp"), "Etc/GMT-2", brief.window_kind(header)).alias("stamp"))


@query(feed_sql("""SELECT f.doc_id, sha256(CASE WHEN o.t IS NOT NULL THEN o.t ELSE own END) AS own, sha256(coalesce(q.t, retweet_of_text)) AS shared, coalesce(o.t, q.t) IS NOT NULL AS translated,
 CASE WHEN o.t IS NOT NULL THEN o.t WHEN own = '' AND q.t IS NOT NULL THEN '' ELSE full_text END = '' AS bare FROM feed f LEFT JOIN tr o ON o.text = f.own AND f.own <> '' LEFT JOIN tr q ON q.text = f.retweet_of_text AND f.retweet_of_text <> ''""",
    "tr AS (SELECT DISTINCT text, 'in English: ' || upper(substr(text, 1, 1)) AS t FROM documents WHERE lang <> 'en' AND text IS NOT NULL)"))
def localized_posts(spark, sf_dir):
    foreign = table(spark, sf_dir, "documents").where("lang <> 'en' and text is not null").select("text", F.concat(F.lit("in English: "), X.capital(F.substring("text", 1, 1))).alias("translation")).distinct()
    found = brief.localized(feed(spark, sf_dir), foreign)
    return found.select("doc_id", F.sha2("own", 256).alias("own"), F.sha2("retweet_of_text", 256).alias("shared"), "translated", (F.col("full_text") == "").alias("bare"))


# -- budgets --------------------------------------------------------------------------------------

_DAY_CHUNKS = "day_chunks AS (SELECT tier, CASE WHEN tier = 'recap' THEN 'normal' ELSE s.level END AS level, section, count(*) AS posts, CAST(sum(words) AS BIGINT) AS words FROM numbered n JOIN sources s ON s.name = n.source GROUP BY ALL)"
_LINES_AT = """lined AS (SELECT c AS compression, 0.83::DOUBLE * CAST(sum(most) AS BIGINT) + 4 * count(DISTINCT section) AS lines FROM
 (SELECT c, section, greatest(1, least(CAST(round_even(greatest(20, CAST(round_even(CASE tier WHEN 'regular' THEN c WHEN 'retweet' THEN 0.04::DOUBLE ELSE 0.16::DOUBLE END * CASE level WHEN 'high' THEN 1.5::DOUBLE WHEN 'low' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * words, 0) AS BIGINT))::DOUBLE / CASE tier WHEN 'recap' THEN 40 ELSE 30 END, 0) AS BIGINT), CASE tier WHEN 'retweet' THEN 8 WHEN 'recap' THEN 20 ELSE 1000000000 END, posts)) AS most
  FROM day_chunks, (SELECT k::DOUBLE / 100 AS c FROM range(10, 26) t(k))) GROUP BY c),
sizes AS (SELECT base * 0.9::DOUBLE + bare AS target, base, bare FROM (SELECT sum(CASE WHEN tier = 'priority' THEN 6::DOUBLE ELSE 1 + CASE WHEN n_images <= 4 THEN n_images * (1 + 4 * 40 / 60::DOUBLE) ELSE 1 END END) AS base, sum(CASE WHEN tier = 'priority' THEN 1::DOUBLE ELSE 0 END) + 1 AS bare FROM feed WHERE tier IN ('priority', 'media')))"""


def _day_chunks(spark, sf_dir):
    levels = derived_sources(spark, sf_dir).select(F.col("name").alias("source"), "level")
    rows = _numbered(spark, sf_dir).join(levels, "source").withColumn("level", F.when(F.col("tier") == "recap", "normal").otherwise(F.col("level")))
    return rows.groupBy("tier", "level", "section").agg(_n("posts"), F.sum("words").alias("words"))


def _sizes(spark, sf_dir):
    """What a day's verbatim posts weigh, whole and at their barest, and a target between."""
    images, first = F.size("images"), F.col("tier") == "priority"
    shown = brief.brief_length(brief.picture_lines(images) + 1, brief.pictures_shown(images))
    rows = feed(spark, sf_dir).where(F.col("tier").isin("priority", "media"))
    sums = rows.agg(F.sum(F.when(first, F.lit(6.0)).otherwise(shown)).alias("base"), (F.sum(F.when(first, 1.0).otherwise(0.0)) + 1).alias("bare"))
    return sums.select((F.col("base") * 0.9 + F.col("bare")).alias("target"), "base", "bare")


@query(feed_sql("SELECT compression, round(lines, 6) AS lines FROM lined", _NUMBERED, SOURCES, _DAY_CHUNKS, _LINES_AT))
def summary_lines(spark, sf_dir):
    return brief.summary_lines(_day_chunks(spark, sf_dir), brief.compression_steps()).select("compression", F.round("lines", 6).alias("lines"))


_CHOSEN = """SELECT compression, round(whole, 6) AS whole, round(lines, 6) AS summary, round(room, 6) AS room, lines <= room AS fits FROM
 (SELECT *, CASE WHEN whole <= target THEN 0.25::DOUBLE ELSE coalesce(step, 0.1::DOUBLE) END AS chosen, CASE WHEN whole <= target THEN target ELSE cut END AS room FROM
  (SELECT s.target, s.base, base + (SELECT lines FROM lined WHERE compression = 0.25) AS whole, least(0.5 * target, target - bare) AS cut, (SELECT max(compression) FROM lined WHERE compression > 0.1 AND lines <= least(0.5 * s.target, s.target - s.bare)) AS step FROM sizes s)) x JOIN lined ON lined.compression = x.chosen"""


@query(feed_sql(_CHOSEN, _NUMBERED, SOURCES, _DAY_CHUNKS, _LINES_AT))
def choose_compression(spark, sf_dir):
    """How far the regular posts are condensed for a brief of nine tenths of what its verbatim posts weigh."""
    lines = brief.summary_lines(_day_chunks(spark, sf_dir), brief.compression_steps())
    return brief.choose_compression(lines, _sizes(spark, sf_dir)).select("compression", *[F.round(c, 6).alias(c) for c in ("whole", "summary", "room")], "fits")


_RANKED = """ranked AS (SELECT doc_id, n_images, row_number() OVER (ORDER BY pos / w, section) AS rank FROM (SELECT doc_id, n_images, section, row_number() OVER (PARTITION BY section ORDER BY turn, newest DESC NULLS LAST, source, id) AS pos, f * count(*) OVER (PARTITION BY section) AS w FROM
 (SELECT *, row_number() OVER (PARTITION BY section, source ORDER BY published DESC NULLS LAST, id) AS turn, max(published) OVER (PARTITION BY section, source) AS newest, CASE WHEN grp = 'de' THEN 0.5::DOUBLE WHEN grp = 'fr' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS f FROM feed WHERE tier = 'media'))),
priced AS (SELECT *, CASE WHEN n_images <= 4 THEN n_images + 1 + n_images * (4 * 40 / 60::DOUBLE) ELSE 2::DOUBLE END AS cost FROM ranked),
shown1 AS (SELECT 0::BIGINT AS rank, 40::DOUBLE * 0.5 AS room, false AS got UNION ALL SELECT p.rank, CASE WHEN p.cost <= f.room THEN f.room - p.cost ELSE f.room END, p.cost <= f.room FROM shown1 f JOIN priced p ON p.rank = f.rank + 1),
spent AS (SELECT 40::DOUBLE - coalesce(sum(p.cost), 0) AS slack FROM shown1 s JOIN priced p ON p.rank = s.rank WHERE s.got),
rest AS (SELECT p.*, row_number() OVER (ORDER BY p.rank) AS place FROM priced p JOIN shown1 s ON s.rank = p.rank WHERE NOT s.got),
lined_posts AS (SELECT rest.* FROM rest, spent WHERE place <= floor(slack)),
shown2 AS (SELECT 0::BIGINT AS place, slack - (SELECT count(*) FROM lined_posts) AS room, false AS got FROM spent UNION ALL SELECT l.place, CASE WHEN l.cost - 1 <= f.room THEN f.room - (l.cost - 1) ELSE f.room END, l.cost - 1 <= f.room FROM shown2 f JOIN lined_posts l ON l.place = f.place + 1)"""


@query(feed_sql("SELECT p.doc_id, p.rank, CASE WHEN s.got OR coalesce(t.got, false) THEN 'pictures' WHEN l.place IS NOT NULL THEN 'line' ELSE 'link' END AS shown FROM priced p JOIN shown1 s ON s.rank = p.rank LEFT JOIN lined_posts l ON l.rank = p.rank LEFT JOIN shown2 t ON t.place = l.place", _RANKED).replace("WITH ", "WITH RECURSIVE ", 1))
def plan_media(spark, sf_dir):
    """Image posts shown in what 40 lines leave."""
    level = F.when(F.col("grp") == "de", "low").when(F.col("grp") == "fr", "high").otherwise("normal")
    ranked = export.rank_media(feed(spark, sf_dir).where("tier = 'media'"), level).select("doc_id", "rank", F.size("images").alias("images"))
    return brief.plan_media(stories.checkpointed(ranked), 40.0).select("doc_id", "rank", "shown")


# -- exports --------------------------------------------------------------------------------------

_LABEL = "CASE WHEN section = 'x' THEN 'X' ELSE 'X / ' || substr(section, 3) END"
_TEXT = f"""text_lines AS (SELECT n, 3 AS rank, line FROM lines UNION ALL SELECT min(n), 0, '' FROM lines GROUP BY section UNION ALL SELECT min(n), 1, '## ' || {_LABEL} FROM lines GROUP BY section
 UNION ALL SELECT min(n), 2, '### ' || CASE tier WHEN 'retweet' THEN 'retweets' ELSE tier END FROM lines GROUP BY section, tier)"""


def _export_text(spark, sf_dir):
    return exports.export_lines(_lines(spark, sf_dir))


@query(feed_sql("SELECT row_number() OVER (ORDER BY n, rank) AS place, line FROM text_lines", _NUMBERED, _LINES, _TEXT))
def export_text(spark, sf_dir):
    from feedloom.plans.numbering import numbered_along

    return numbered_along(_export_text(spark, sf_dir), [F.col("at")], "place").select("place", "line")


@query(feed_sql(f"SELECT n, {_LABEL} AS section, substr(line, length('[' || n || '] ') + 1) AS line, CASE WHEN n % 11 = 0 THEN NULL ELSE tier END AS tier, CASE WHEN n % 11 = 0 OR n % 7 = 0 THEN len(regexp_extract_all(substr(line, length('[' || n || '] ') + 1), '\\S+')) ELSE CAST(words AS BIGINT) END AS words, CASE WHEN n % 11 = 0 THEN '' ELSE grp END AS grp, n % 11 <> 0 AS known FROM lines", _NUMBERED, _LINES))
def parse_export(spark, sf_dir):
    """An export read back; the map lacks every eleventh post, and words of every seventh."""
    rows = _lines(spark, sf_dir)
    mapping = rows.where("n % 11 <> 0").select("n", "tier", F.when(F.col("n") % 7 != 0, F.col("words")).alias("words"), "grp")
    return exports.parse_export(_export_text(spark, sf_dir), mapping)


_HINTED = f"""{_SETS}, {_LEADERS}, {_MEMBERS},
hinted AS (SELECT m.leader, list_sort(list(n.n)) AS ns FROM members m JOIN numbered n ON n.id = m.id GROUP BY m.leader HAVING count(DISTINCT n.source) >= 2)"""


def _hints(spark, sf_dir):
    items = feed(spark, sf_dir)
    return exports.hints(stories.stories(items).select("id", "leader"), _numbered(spark, sf_dir, "id"))


@query(feed_sql("SELECT leader, 'repeated: ' || array_to_string(list_transform(ns, lambda x: '[' || x || ']'), ' ') AS line FROM hinted", _NUMBERED, _HINTED))
def repeated_hints(spark, sf_dir):
    found = _hints(spark, sf_dir)
    lines = exports.repeated_lines(found, F.lit(0))
    return found.join(lines, F.element_at("ns", 1) == F.col("at.n")).select("leader", "line")


@query(feed_sql("SELECT n, CASE WHEN tier = 'retweet' AND n IN (SELECT unnest(ns) FROM hinted) THEN 'regular' ELSE tier END AS tier FROM numbered", _NUMBERED, _HINTED))
def promoted_retweets(spark, sf_dir):
    return exports.promoted(_numbered(spark, sf_dir, "id"), _hints(spark, sf_dir)).select("n", "tier")


@query(feed_sql("SELECT chunk, leader, array_to_string(list_sort(list(n)), ' ') AS ns FROM (SELECT leader, unnest(ns) AS n FROM hinted) h JOIN (SELECT f.n, p.chunk FROM folded f JOIN named_parts p ON p.tier = f.tier AND p.level = f.level AND p.stream = f.stream AND p.part = f.part) c USING (n) GROUP BY chunk, leader HAVING count(*) >= 2", _NUMBERED, _LINES, SOURCES, _PACKED, _HINTED).replace("WITH ", "WITH RECURSIVE ", 1))
def chunk_hints(spark, sf_dir):
    packed, parts = _chunked(spark, sf_dir)
    placed = packed.join(parts.select("tier", "level", "stream", "part", "chunk"), ["tier", "level", "stream", "part"])
    return exports.cut_to_chunks(_hints(spark, sf_dir), placed).select("chunk", "leader", F.array_join(F.col("ns").cast("array<string>"), " ").alias("ns"))


@query(feed_sql("SELECT leader, row_number() OVER (ORDER BY NOT starred, sources DESC, first, leader) AS place FROM (SELECT m.leader, count(DISTINCT m.source) AS sources, bool_or(m.source = '@src3') AS starred, min((CASE WHEN m.published IS NULL THEN '1' ELSE '0' END) || coalesce(strftime(m.published, '%Y%m%d%H%M%S'), '') || m.id) AS first FROM members m GROUP BY m.leader HAVING count(DISTINCT m.source) >= 2)", _SETS, _LEADERS, _MEMBERS))
def story_order(spark, sf_dir):
    items = feed(spark, sf_dir)
    members = stories.checkpointed(stories.stories(items))
    return stories.in_reading_order(stories.told_by(members, items), members, items, F.col("source") == PRIORITY).select("leader", "place")


@query(feed_sql("SELECT n.n, f.doc_id IS NOT NULL AS there FROM numbered n LEFT JOIN (SELECT * FROM feed WHERE doc_id % 13 <> 0) f ON f.url = n.url", _NUMBERED))
def absent_posts(spark, sf_dir):
    """Numbered posts looked for in a store that lost every thirteenth."""
    stored = derived_feed(spark, sf_dir).where("doc_id % 13 <> 0").select("url", F.lit(True).alias("_there"))
    return _numbered(spark, sf_dir).select("n", "url").join(stored, "url", "left").select("n", F.coalesce("_there", F.lit(False)).alias("there"))


# -- runs -----------------------------------------------------------------------------------------

_RESULTS = """results AS (SELECT source, doc_id % 7 <> 3 AS ok, doc_id % 10 / 4.0::DOUBLE AS seconds, length(text) AS prompt_chars, CASE WHEN doc_id % 5 <> 0 THEN length(text) // 4 END AS prompt_tokens, CASE WHEN doc_id % 5 <> 0 THEN 100 + doc_id % 50 END AS completion_tokens, doc_id % 90 AS reply_words, 80 AS target_words FROM documents)"""


def _results(spark, sf_dir):
    i, chars = F.col("doc_id"), F.length("text")
    return table(spark, sf_dir, "documents").select(
        "source", (i % 7 != 3).alias("ok"), ((i % 10) / F.lit(4.0)).alias("seconds"), chars.alias("prompt_chars"), F.when(i % 5 != 0, F.floor(chars / 4)).alias("prompt_tokens"),
        F.when(i % 5 != 0, 100 + i % 50).alias("completion_tokens"), (i % 90).alias("reply_words"), F.lit(80).alias("target_words"),
    )


@query(f"""WITH {_RESULTS} SELECT source, count(*) AS chunks, count(CASE WHEN ok THEN 1 END) AS ok, count(CASE WHEN NOT ok THEN 1 END) AS failed, round_even(sum(seconds), 1) AS seconds, CAST(coalesce(sum(CASE WHEN prompt_tokens > 0 THEN prompt_tokens END), 0) AS BIGINT) AS prompt_tokens,
 CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens, CAST(coalesce(sum(CASE WHEN ok THEN reply_words END), 0) AS BIGINT) AS reply_words, CAST(sum(target_words) AS BIGINT) AS target_words,
 round_even(CAST(sum(CASE WHEN prompt_tokens > 0 THEN prompt_chars END) AS DOUBLE) / CAST(sum(CASE WHEN prompt_tokens > 0 THEN prompt_tokens END) AS DOUBLE), 2) AS chars_per_token FROM results GROUP BY source""")
def run_totals(spark, sf_dir):
    return runs.run_totals(_results(spark, sf_dir), "source")


@query(f"WITH {_RESULTS} SELECT source, CAST(sum(prompt_tokens) AS BIGINT) AS tokens_in, CAST(sum(completion_tokens) AS BIGINT) AS tokens_out, count(*) AS calls FROM results WHERE prompt_tokens IS NOT NULL GROUP BY source")
def token_usage(spark, sf_dir):
    return runs.usage(_results(spark, sf_dir), "source")


@query(r"SELECT source, tokens_in, tokens_out, round(tokens_in * 0.0000002::DOUBLE + tokens_out * 0.0000008::DOUBLE, 9) AS cost FROM (SELECT source, CAST(round_even(CAST(sum(coalesce(len(regexp_extract_all(text, '\S+')), 0)) AS DOUBLE) * 1.4::DOUBLE, 0) AS BIGINT) AS tokens_in, 700 * count(*) AS tokens_out FROM documents GROUP BY source)")
def cost_estimate(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("source", F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).alias("words"))
    return runs.estimate_cost(words, 0.0000002, 0.0000008, "source").withColumn("cost", F.round("cost", 9))


@query(feed_sql("SELECT n, CAST(ceil(length(line) / 3.6::DOUBLE) AS BIGINT) AS tokens FROM lines", _NUMBERED, _LINES))
def token_estimates(spark, sf_dir):
    return _lines(spark, sf_dir).select("n", runs.estimate_tokens(F.col("line")).alias("tokens"))


@query(feed_sql("SELECT chunk, least(3200, greatest(500, CASE tier WHEN 'recap' THEN 140 ELSE 100 END * max_items + 300)) AS budget FROM (SELECT chunk, tier, greatest(1, least(CAST(round_even(target::DOUBLE / CASE tier WHEN 'recap' THEN 40 ELSE 30 END, 0) AS BIGINT), CASE tier WHEN 'retweet' THEN 8 WHEN 'recap' THEN 20 ELSE 1000000000 END, posts)) AS max_items FROM named_parts)", _NUMBERED, _LINES, SOURCES, _PACKED).replace("WITH ", "WITH RECURSIVE ", 1))
def reply_budgets(spark, sf_dir):
    return _chunked(spark, sf_dir)[1].select("chunk", runs.reply_budget(F.col("tier"), F.col("max_items")).alias("budget"))


_FAULTS = ["no `items` list", "item 1 is not an object", "item 0: headline and detail must be strings", "item 1: ids must be a list of integers", "too thin: 2 item(s) for 9 posts, at least 3 expected"]


@query("SELECT item_id, CASE item_id % 6 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_FAULTS)) + " END AS problem FROM benchmark")
def reply_problems(spark, sf_dir):
    """Replies with every fault there is, and whole ones."""
    i = F.col("item_id")
    good = F.to_json(F.struct(F.substring("text", 1, 20).alias("headline"), F.col("text").alias("detail"), F.array(i, i + 1).alias("ids")))
    odd = {1: F.lit("7"), 2: F.lit('{"headline": null, "detail": "x", "ids": []}'), 3: F.lit('{"headline": "a", "detail": "b", "ids": [1, true]}')}
    items = lambda *parts: F.concat(F.lit('{"items": ['), F.concat_ws(", ", *parts), F.lit("]}"))
    raw = F.when(i % 6 == 0, '{"posts": []}').when(i % 6 == 1, items(good, odd[1], good)).when(i % 6 == 2, items(odd[2], odd[1], good)).when(i % 6 == 3, items(good, odd[3], good)).when(i % 6 == 4, items(good, good)).otherwise(items(good, good, good))
    return table(spark, sf_dir, "benchmark").select("item_id", runs.reply_problem(raw, F.lit(3), F.lit(9)).alias("problem"))


_FILES = """files AS (SELECT CASE doc_id % 2 WHEN 0 THEN 'runs' ELSE 'exports' END AS folder, CASE doc_id % 2 WHEN 0 THEN 'run' || doc_id // 6 ELSE 'day' || doc_id // 4 || '.txt' END AS entry, doc_id * 37 % 211 AS mtime, CASE WHEN doc_id % 2 = 0 THEN 'day' || doc_id // 8 END AS export, 'f' || doc_id AS name FROM documents)"""


def _files(spark, sf_dir):
    i = F.col("doc_id")
    run = i % 2 == 0
    name = lambda head, n, tail="": F.concat(F.lit(head), F.floor(i / n).cast("string"), F.lit(tail))
    return table(spark, sf_dir, "documents").select(F.when(run, "runs").otherwise("exports").alias("folder"), F.when(run, name("run", 6)).otherwise(name("day", 4, ".txt")).alias("entry"), (i * 37 % 211).alias("mtime"), F.when(run, name("day", 8)).alias("export"), F.concat(F.lit("f"), i.cast("string")).alias("name"))


@query(f"""WITH {_FILES}, entries AS (SELECT folder, entry, max(mtime) AS mtime, max(export) AS export FROM files GROUP BY ALL)
SELECT folder, entry FROM entries WHERE mtime < 150 AND NOT (folder = 'exports' AND split_part(entry, '.', 1) IN (SELECT export FROM entries WHERE folder = 'runs' AND mtime >= 150))""")
def forgotten_files(spark, sf_dir):
    return runs.forgotten(_files(spark, sf_dir), F.lit(150))


@query(f"WITH {_FILES} SELECT folder, entry, arg_max(name, lpad(CAST(mtime AS VARCHAR), 6, '0') || name) AS name, max(mtime) AS mtime FROM files GROUP BY folder, entry")
def newest_files(spark, sf_dir):
    return runs.newest(_files(spark, sf_dir), "folder", "entry")


@query(feed_sql("SELECT tier, count(*) AS items, CAST(sum(words) AS BIGINT) AS words, count(CASE WHEN tier = 'media' THEN 1 END) AS image_posts, CAST(coalesce(sum(CASE WHEN tier = 'media' THEN n_images END), 0) AS BIGINT) AS images FROM feed GROUP BY tier"))
def freeze_manifest(spark, sf_dir):
    return runs.freeze_manifest(feed(spark, sf_dir)).withColumn("images", F.col("images").cast("bigint"))


@query(feed_sql("SELECT min(fetched_at) AS started, count(DISTINCT source) AS sources FROM feed"))
def history_start(spark, sf_dir):
    return derived_feed(spark, sf_dir).agg(F.min("fetched_at").alias("started"), F.countDistinct("source").alias("sources"))


# -- languages and ads ----------------------------------------------------------------------------


def _short(spark, sf_dir):
    """Texts of all lengths: links, handles and tags alone, and prose."""
    i = F.col("doc_id").cast("string")
    lead = F.concat(F.lit("@user"), i, F.lit(" #tag $ABC https://x.example/"), i, F.lit(" "))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.concat(lead, F.when(F.col("doc_id") % 3 == 0, F.substring(F.coalesce("text", F.lit("")), 1, 3)).otherwise(F.coalesce("text", F.lit("")))).alias("text"))


_SHORT = "short AS (SELECT doc_id, lang, source, '@user' || doc_id || ' #tag $ABC https://x.example/' || doc_id || ' ' || CASE WHEN doc_id % 3 = 0 THEN substr(coalesce(text, ''), 1, 3) ELSE coalesce(text, '') END AS text FROM documents)"


@query(rf"WITH {_SHORT} SELECT doc_id, length(regexp_replace(regexp_replace({_no_urls('text')}, '[@#$][\p{{L}}\p{{N}}_]+', ' ', 'g'), '[^\p{{L}}]', '', 'g')) >= 4 AS worth FROM short")
def worth_checking(spark, sf_dir):
    return _short(spark, sf_dir).select("doc_id", language.worth_checking(F.col("text")).alias("worth"))


@query(f"WITH {_SHORT} SELECT doc_id, lang, length(text) > 3000 AS too_long FROM short WHERE lang IS NOT NULL AND lang NOT IN ('en', 'de')")
def foreign_texts(spark, sf_dir):
    return language.foreign(_short(spark, sf_dir), ["en", "de"]).select("doc_id", "lang", "too_long")


@query(f"WITH {_SHORT}, keyed AS (SELECT *, substr(sha256('Say the language.' || chr(0) || text), 1, 16) AS key FROM short) SELECT k.doc_id, k.key, c.lang AS answer FROM keyed k LEFT JOIN (SELECT DISTINCT key, lang FROM keyed WHERE doc_id % 2 = 0) c ON c.key = k.key")
def cache_split(spark, sf_dir):
    """Texts asked about before, and those that weren't: half are in the cache."""
    texts, system = _short(spark, sf_dir), "Say the language."
    cache = texts.where("doc_id % 2 = 0").select(language.cache_key(system, F.col("text")).alias("key"), F.col("lang").alias("answer")).distinct()
    return language.split_by_cache(texts, cache, system).select("doc_id", "key", "answer")


@query(rf"WITH {_SHORT} SELECT doc_id, (at - 1) // 25 AS batch, CAST((at - 1) % 25 + 1 AS INT) AS k, sha256('[' || ((at - 1) % 25 + 1) || '] ' || trim(regexp_replace(substr(text, 1, 300), '\s+', ' ', 'g'))) AS line FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS at FROM short)".replace(" at ", " nth ").replace("(at ", "(nth "))
def detect_batches(spark, sf_dir):
    made = language.batches(_short(spark, sf_dir), [F.col("doc_id")], language.DETECT_BATCH, language.DETECT_CHARS)
    return made.select("doc_id", "batch", "k", F.sha2("line", 256).alias("line"))


@query("""WITH placed AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 20 AS batch, (row_number() OVER (ORDER BY doc_id) - 1) % 20 + 1 AS k FROM documents)
SELECT doc_id, batch, CASE WHEN batch % 4 = 1 OR k = 20 THEN NULL ELSE k % 3 = 0 END AS ad FROM placed""")
def judged_ads(spark, sf_dir):
    """Replies that say every third post of a batch is an ad, take it back later, leave the last out and name posts there are none of; every fourth call failed."""
    made = language.batches(_short(spark, sf_dir), [F.col("doc_id")], language.ADS_BATCH, language.ADS_CHARS)
    calls = made.select("batch").distinct().where("batch % 4 <> 1")
    n = F.explode(F.sequence(F.lit(1), F.lit(19)))
    said = calls.select("batch", n.alias("n")).select("batch", F.col("n").alias("at"), "n", (F.col("n") % 3 == 0).alias("ad"))
    again = said.select("batch", (F.col("at") + 100).alias("at"), "n", (~F.col("ad")).alias("ad"))
    none = calls.select("batch", F.lit(500).alias("at"), F.lit(77).alias("n"), F.lit(True).alias("ad"))
    return language.judged(made, said.unionByName(again).unionByName(none)).select("doc_id", "batch", "ad")


@query("SELECT lang, n, row_number() OVER (ORDER BY n DESC, lang) AS place FROM (SELECT lang, count(*) AS n FROM documents WHERE lang <> 'en' GROUP BY lang)")
def translations_by_language(spark, sf_dir):
    return language.translations_by_language(table(spark, sf_dir, "documents").where("lang <> 'en'"))


@query(feed_sql("SELECT doc_id FROM feed WHERE doc_id % 6 <> 1"))
def hidden_ads(spark, sf_dir):
    items = derived_feed(spark, sf_dir)
    return items.join(items.where("doc_id % 6 = 1").select("id"), "id", "left_anti").select("doc_id")


@query(feed_sql("SELECT source, count(*) AS n, array_to_string(list(url ORDER BY coalesce(published, TIMESTAMP '0001-01-01'), id), ' ') AS urls FROM feed WHERE doc_id % 6 = 1 GROUP BY source"))
def ads_by_account(spark, sf_dir):
    found = language.ads_by_account(derived_feed(spark, sf_dir).where("doc_id % 6 = 1"))
    return found.select("source", "n", F.array_join("urls", " ").alias("urls"))


@query("SELECT DISTINCT source AS handle FROM documents WHERE CAST(substr(source, 4) AS INT) % 3 = 0")
def blocked_handles(spark, sf_dir):
    """Handles on a list that has them in other case, with marks and twice."""
    handles = table(spark, sf_dir, "documents").select(F.col("source").alias("handle")).distinct()
    some = handles.where(F.substring("handle", 4, 10).cast("int") % 3 == 0).select(F.concat(F.lit(" @"), F.upper("handle"), F.lit(" ")).alias("value"))
    return language.blocked(handles, language.block_list(some.union(some).union(spark.createDataFrame([("",)], "value string"))))


@query(feed_sql("SELECT doc_id, row_number() OVER (ORDER BY published DESC NULLS LAST, id) AS place FROM feed WHERE doc_id % 4 = 2"))
def newest_of_ids(spark, sf_dir):
    """Posts looked up by id, newest first, undated last."""
    from feedloom.plans.numbering import numbered_along

    items = derived_feed(spark, sf_dir)
    wanted = items.where("doc_id % 4 = 2").select("id")
    order = [F.col("published").isNull(), -F.unix_micros(F.col("published").cast("timestamp")), F.col("id")]
    return numbered_along(items.join(wanted, "id", "left_semi"), order, "place").select("doc_id", "place")


@query(feed_sql("SELECT p.doc_id, p.doc_id % 3 = 1 AND ((p.doc_id // 3 * 3) % 2 = 1 OR p.doc_id % 2 = 0) AS thread_reply FROM feed p"))
def known_threads(spark, sf_dir):
    """Every third post is a reply in the thread of the post before it, whose id the store has, or the batch."""
    i = F.col("doc_id")
    root = (F.floor(i / 3) * 3).cast("string")
    items = derived_feed(spark, sf_dir).select("doc_id", F.concat(F.lit("s"), i.cast("string")).alias("status"), F.when(i % 3 == 1, F.concat(F.when(i % 2 == 0, F.lit("s")).otherwise(F.lit("old")), root)).otherwise("").alias("thread_root"), "published", i.alias("pos"))
    stored = items.where("thread_root like 'old%'").select(F.col("thread_root").alias("status")).where(F.substring("status", 4, 20).cast("bigint") % 2 == 1)
    return posts.thread_replies(items, stored).select("doc_id", "thread_reply")


@query(feed_sql(f"SELECT source, CAST(count(*) AS BIGINT) AS fetched, count(*) >= 40 AS warned FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM feed) WHERE rn <= 40 GROUP BY source"))
def fetch_ceilings(spark, sf_dir):
    """At most twice 20 posts of a source, in the order they come."""
    from pyspark.sql.window import Window

    from feedloom.sources.timeline import item_ceiling

    most, _ = item_ceiling(20, billed_by_call=True, max_age_hours=24)
    rows = derived_feed(spark, sf_dir).withColumn("_rn", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where(F.col("_rn") <= most)
    return rows.groupBy("source").agg(F.count("*").alias("fetched")).withColumn("warned", F.col("fetched") >= most)



# -- whole pages ----------------------------------------------------------------------------------


@query(feed_sql(f"""SELECT p.chunk, sha256('Band: ' || CASE p.tier WHEN 'retweet' THEN 'retweets' ELSE p.tier END || chr(10) || CASE WHEN p.level <> 'normal' THEN 'Importance: ' || p.level || chr(10) ELSE '' END || 'Length: at most ' || p.max_items || ' items' || CASE WHEN p.tier = 'recap' THEN ', each theme citing at most 5 posts' ELSE '' END || ' and about ' || p.target || ' words in total, all headlines and details together; shorter is fine.' || chr(10)
 || b.body || CASE WHEN h.told IS NOT NULL THEN chr(10) || chr(10) || '## repeated stories' || chr(10) || h.told ELSE '' END || chr(10)) AS digest
FROM (SELECT *, greatest(1, least(CAST(round_even(target::DOUBLE / CASE tier WHEN 'recap' THEN 40 ELSE 30 END, 0) AS BIGINT), CASE tier WHEN 'retweet' THEN 8 WHEN 'recap' THEN 20 ELSE 1000000000 END, posts)) AS max_items FROM named_parts) p
JOIN (SELECT chunk, string_agg(CASE WHEN before IS NULL OR before <> section THEN chr(10) || '## ' || {_LABEL} || chr(10) || line ELSE line END, chr(10) ORDER BY n) AS body FROM (SELECT *, lag(section) OVER (PARTITION BY chunk ORDER BY n) AS before FROM chunk_posts) GROUP BY chunk) b ON b.chunk = p.chunk
LEFT JOIN (SELECT chunk, string_agg('repeated: ' || array_to_string(list_transform(ns, lambda x: '[' || x || ']'), ' '), chr(10) ORDER BY ns) AS told FROM (SELECT chunk, leader, list_sort(list(n)) AS ns FROM (SELECT leader, unnest(ns) AS n FROM hinted) JOIN chunk_posts USING (n) GROUP BY chunk, leader HAVING count(*) >= 2) GROUP BY chunk) h ON h.chunk = p.chunk""",
    _NUMBERED, _LINES, SOURCES, _PACKED, "chunk_posts AS (SELECT f.n, c.chunk, f.section, l.line FROM folded f JOIN named_parts c ON c.tier = f.tier AND c.level = f.level AND c.stream = f.stream AND c.part = f.part JOIN lines l ON l.n = f.n)", _HINTED).replace("WITH ", "WITH RECURSIVE ", 1))
def chunk_messages(spark, sf_dir):
    packed, parts = _chunked(spark, sf_dir)
    placed = packed.join(parts.select("tier", "level", "stream", "part", "chunk"), ["tier", "level", "stream", "part"]).select("chunk", "n", "section", "line")
    hints = exports.cut_to_chunks(_hints(spark, sf_dir), placed)
    return documents.messages(placed, parts, hints).select("chunk", F.sha2("message", 256).alias("digest"))


@query(feed_sql(f"""SELECT kind, section, band, count(*) AS lines FROM
 (SELECT tier AS kind, section, CASE tier WHEN 'priority' THEN 1 WHEN 'media' THEN 2 WHEN 'regular' THEN 3 ELSE 4 END AS band FROM feed WHERE tier <> 'recap'
 UNION ALL SELECT DISTINCT 'band', section, CASE tier WHEN 'priority' THEN 1 WHEN 'media' THEN 2 WHEN 'regular' THEN 3 WHEN 'retweet' THEN 4 ELSE 5 END FROM feed UNION ALL SELECT DISTINCT 'section', section, 0 FROM feed
 UNION ALL SELECT 'story', CASE WHEN alone THEN section ELSE '' END, CASE WHEN alone THEN 6 ELSE -1 END FROM told UNION ALL SELECT DISTINCT 'section', '', -2 FROM told WHERE NOT alone) GROUP BY ALL""",
    _SETS, _LEADERS, _MEMBERS, "told AS (SELECT m.leader, min(m.section) AS section, bool_and(f.grp = 'de' AND f.tier <> 'priority') AS alone FROM members m JOIN feed f ON f.id = m.id GROUP BY m.leader HAVING count(DISTINCT m.source) >= 2)"))
def quick_digest(spark, sf_dir):
    """Lines of the one-line digest by section and band; stories of one recap group alone stand in its section."""
    items = feed(spark, sf_dir)
    members = stories.checkpointed(stories.stories(items))
    firsts = stories.first_by_source(members, items).join(items.select("id", "url", "published"), "id")
    texts = items.select(F.col("id").alias("leader"), X.story_text(F.col("own")).alias("text"))
    lines = render.story_lines(stories.told_by(members, items), firsts, texts, F.col("source") == PRIORITY)
    alone = members.join(items.select("id", "section", "grp", "tier"), "id").groupBy("leader").agg(F.min("section").alias("_s"), F.bool_and((F.col("grp") == "de") & (F.col("tier") != "priority")).alias("_alone"))
    placed = stories.kept(lines.join(alone, "leader").withColumn("section", F.when(F.col("_alone"), F.col("_s")).otherwise("")))
    page = documents.quick(items, placed, F.col("source") == PRIORITY)
    return page.groupBy("kind", F.col("at.section").alias("section"), F.col("at.band").alias("band")).agg(F.count("line").alias("lines"))


@query(_told_sql("""SELECT kind, section, place, rank FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY part, chunk, item) AS place FROM
 (SELECT 'section' AS kind, section, 0 AS part, '' AS chunk, 0 AS item, rank FROM tops UNION ALL SELECT 'lead', section, 1, '', 0, rank FROM tops WHERE section <> 'x/fr' UNION ALL SELECT 'bullet', section, 2, CAST(chunk AS VARCHAR), item, rank FROM kept))""",
    "kept AS (SELECT chunk, item, CASE WHEN grp = '' THEN 'x' ELSE 'x/' || grp END AS section, CASE WHEN grp = 'de' THEN 3 WHEN grp = 'fr' THEN 0 WHEN grp = 'es' THEN 2 ELSE 1 END AS rank FROM outcomes WHERE outcome = 'kept'), tops AS (SELECT DISTINCT section, rank FROM kept)"))
def brief_page(spark, sf_dir):
    """Summaries by section; one section has no lead."""
    from pyspark.sql.window import Window

    replies, outcomes = _outcomes(spark, sf_dir)
    grp = F.col("grp")
    kept = outcomes.where("outcome = 'kept'").join(replies.select("chunk", "item", "headline", "detail"), ["chunk", "item"])
    kept = kept.withColumns({"section": X.section_key(F.lit("x"), grp), "level": _level(grp), "recap": grp == "de"})
    posted = derived_feed(spark, sf_dir).select(F.col("doc_id").alias("n"), "source", "url")
    leads = kept.select("section").distinct().withColumn("lead", F.when(F.col("section") != "x/fr", "What it was *about*."))
    page = documents.brief_lines(kept, render.cite_links(kept, posted, F.col("recap")), leads)
    place = F.row_number().over(Window.partitionBy("at.section").orderBy("at"))
    return page.where("line is not null").select("kind", "at.section", place.alias("place"), "at.rank")
