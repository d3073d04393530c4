"""Saved links, conversations and web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedloom.functions import text as X
from feedloom.plans.lineage import checkpointed


# What a summary is made of, and which hosts show posts again.
SHORT_WORDS, LONG_CHARS, MAX_THREAD = 60, 280, 200
MAX_TOKENS, WINDOW_TOKENS_PER_WORD, HEADER_WORDS = 2000, 2.0, 200
KINDS = ("article", "thread", "long", "post", "web")
_X = r"(?i)(?<![\w.-])(?:https?://)?(?:www\.|mobile\.)?(?:x|twitter)\.com/"
STATUS = _X + r"(?:i/web/|i/|\w{1,15}/)status(?:es)?/(\d+)"
ARTICLE = _X + r"i/article/(\d+)"
WEB = r"(?i)https?://[^\s<>\"'`\[\]]+"
X_HOSTS = r"(?:^|\.)(?:x|twitter|fxtwitter|vxtwitter|fixupx|fixvx)\.com$|^t\.co$"


def trimmed(url: Column) -> Column:
    """A link without the prose around it: no fragment, no closing marks, no bracket that was never opened.

    Of the marks at its end as many closing brackets stay as the rest has open ones, and what stands before the last
    of them.
    """
    bare = F.substring_index(url, "#", 1)
    head = F.regexp_replace(bare, r"[.,;:!?*)]+$", "")
    tail = F.split(F.substring(bare, F.length(head) + 1, F.length(bare)), r"\)", -1)
    still_open = F.regexp_count(head, F.lit(r"\(")) - F.regexp_count(head, F.lit(r"\)"))
    stay = F.greatest(F.lit(0), F.least(F.size(tail) - 1, still_open))
    closed = F.transform(F.slice(tail, F.lit(1), stay), lambda x: F.concat(x, F.lit(")")))
    return F.concat(head, F.array_join(closed, ""))


def _first_seen(texts: DataFrame, key: str, found: Column, name: str) -> DataFrame:
    rows = texts.select(key, F.posexplode(found).alias("pos", name))
    return rows.groupBy(key, name).agg(F.min("pos").cast("bigint").alias("pos"))


def links(texts: DataFrame, key: str, text: Column) -> DataFrame:
    """``key``, ``url``, ``pos``: distinct links of a text to web pages, in the order they first appear.

    A host has a dot and shows no posts of X.
    """
    found = F.transform(F.regexp_extract_all(text, F.lit(WEB), 0), trimmed)
    return _first_seen(texts, key, F.filter(found, lambda u: F.contains(host(u), F.lit(".")) & ~host(u).rlike(X_HOSTS)), "url")


def status_ids(texts: DataFrame, key: str, text: Column) -> DataFrame:
    """``key``, ``status``, ``pos``: distinct posts that a text links, in the order they first appear."""
    return _first_seen(texts, key, F.regexp_extract_all(text, F.lit(STATUS), 1), "status")


def article_ids(texts: DataFrame, key: str, text: Column) -> DataFrame:
    return _first_seen(texts, key, F.regexp_extract_all(text, F.lit(ARTICLE), 1), "article")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@\s]*@)?([^/:?#\s]+)", 1))


def self_chain(posts: DataFrame, most: int = MAX_THREAD) -> DataFrame:
    """``root``, ``id``, ``depth``: from each thread's first post down its author's own replies, the least reply first.

    ``posts``: ``id``, ``parent``, ``author``.  One join on the parent a step, until
    no chain goes on or ``most`` posts are reached; steps are checkpointed, so
    neither their number nor the chains' is bound by the limits of recursive queries.
    """
    start = posts.where("parent is null").select(F.col("id").alias("root"), "id", "author", F.lit(1).cast("bigint").alias("depth"))
    return _down(posts, start, most).select("root", "id", "depth")


def _down(posts: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """Chains ``root``, ``id``, ``author``, ``depth`` continued by the author's least reply each, ``most`` deep at most.

    A post has one parent, so only a post of the chain above the start can come again, and it is looked for there.
    """
    w = Window.partitionBy("parent", "author").orderBy("id")
    next_ = posts.where("parent is not null").withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    next_ = checkpointed(next_.select(F.col("id").alias("_id"), F.col("parent").alias("_parent"), F.col("author").alias("_author")))
    step = chain = checkpointed(start)
    while True:
        on = (F.col("_parent") == F.col("id")) & (F.col("_author") == F.col("author"))
        step = step.where(F.col("depth") < most).join(next_, on).select("root", F.col("_id").alias("id"), "author", (F.col("depth") + 1).alias("depth"))
        step = checkpointed(step.join(chain.select("root", "id"), ["root", "id"], "left_anti").select("root", "id", "author", "depth"))
        if step.isEmpty():
            return chain
        chain = chain.union(step)


def thread_of(posts: DataFrame, saved: DataFrame, most: int = MAX_THREAD) -> DataFrame:
    """``saved``, ``id``, ``place`` (1..): the author's own thread that runs through each saved post.

    Up to the post that starts it, then down from the saved post by the least reply; a reply to or by somebody else
    ends it, as does a post that is in it already or ``most`` posts.
    """
    own = posts.where("parent is not null").join(posts.select(F.col("id").alias("parent"), F.col("author").alias("_pa")), "parent").where("author = _pa").select(F.col("id").alias("_child"), F.col("parent").alias("_up"))
    own = checkpointed(own)
    step = chain = checkpointed(posts.join(saved.select("id"), "id", "left_semi").select(F.col("id").alias("root"), "id", "author", F.lit(0).cast("bigint").alias("depth")))
    while True:
        step = step.where(-F.col("depth") + 1 < most).join(own, F.col("id") == F.col("_child")).select("root", F.col("_up").alias("id"), "author", (F.col("depth") - 1).alias("depth"))
        step = checkpointed(step.join(chain.select("root", "id"), ["root", "id"], "left_anti").select("root", "id", "author", "depth"))
        if step.isEmpty():
            break
        chain = chain.union(step)
    above = checkpointed(chain.withColumn("_first", F.min("depth").over(Window.partitionBy("root"))))
    ends = above.where("depth = 0").select("root", "id", "author", (1 - F.col("_first")).alias("depth"))
    upper = above.select("root", "id", "author", (F.col("depth") - F.col("_first") + 1).alias("depth")).join(ends.select("root", "id"), ["root", "id"], "left_anti")
    below = _down_from(posts, upper.select("root", "id", "author", "depth"), ends, most)
    return below.select(F.col("root").alias("saved"), "id", F.col("depth").cast("bigint").alias("place"))


def _down_from(posts: DataFrame, upper: DataFrame, ends: DataFrame, most: int) -> DataFrame:
    """Posts above, and the chain from each end down, none of them twice."""
    w = Window.partitionBy("root").orderBy("id")
    replies = checkpointed(posts.where("parent is not null").select(F.col("id").alias("_id"), F.col("parent").alias("_parent"), F.col("author").alias("_author")))
    step = checkpointed(ends)
    chain = checkpointed(upper).union(step)
    while True:
        on = (F.col("_parent") == F.col("id")) & (F.col("_author") == F.col("author"))
        found = step.where(F.col("depth") < most).join(replies, on).select("root", F.col("_id").alias("id"), "author", (F.col("depth") + 1).alias("depth"))
        fresh = found.join(chain.select("root", "id"), ["root", "id"], "left_anti")
        step = checkpointed(fresh.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("root", "id", "author", "depth"))
        if step.isEmpty():
            return chain
        chain = chain.union(step)


def entries(threads: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved posts made one entry a thread: ``saved``, ``entry`` (the first saved post of it), ``places`` of all saved ones.

    ``threads`` is what ``thread_of`` gives, ``saved``: id, pos (place in the list).
    """
    members = threads.join(saved.select(F.col("id").alias("saved"), "pos"), "saved")
    first = members.groupBy("id").agg(F.min_by("saved", "pos").alias("entry"))
    of = saved.select("id", "pos").join(first, "id")
    at = of.join(threads.select(F.col("saved").alias("entry"), "id", "place"), ["entry", "id"])
    return at.groupBy("entry").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_set("place")).alias("places"))


def as_posted(words: Column) -> Column:
    """Short enough to be shown as it is."""
    return words <= SHORT_WORDS


def may_be_thread(answers_self: Column, replies: Column) -> Column:
    """A search for a thread can find something: a reply to oneself is in one, a post that nobody replied to starts none."""
    return answers_self | ~F.coalesce(replies == 0, F.lit(False))


def clean_text(text: Column) -> Column:
    """Entities decoded, short links out, spaces single, one blank line at most."""
    plain = X.unescape(F.regexp_replace(text, r"https?://t\.co/\w+", ""))
    lines = F.transform(F.split(plain, r"\r\n|[\n\r]", -1), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.btrim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), F.lit(" \n\t"))


def kind_counts(found: DataFrame) -> DataFrame:
    """``kind``, ``n``, ``place`` of the kinds there are, in their fixed order."""
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return found.groupBy("kind").agg(F.count("*").alias("n")).withColumn("place", order.cast("int"))


def foreign_links(tweets: DataFrame, key: str = "entry") -> DataFrame:
    """``key``, ``url``, ``pos``: links that an entry's posts carry, without its own posts and those they quote.

    ``tweets``: key, at (place in the entry), id, quoted, urls.
    """
    own = tweets.select(key, F.col("id").alias("_s")).unionByName(tweets.select(key, F.col("quoted").alias("_s"))).where("_s is not null").distinct()
    rows = tweets.select(key, "at", F.posexplode("urls").alias("_p", "url")).where(F.col("url").rlike("^https?://")).withColumn("_s", F.nullif(F.regexp_extract("url", "^" + STATUS, 1), F.lit("")))
    told = rows.join(own.withColumn("_own", F.lit(True)), [key, "_s"], "left").where("_own is null")
    first = told.groupBy(key, "url").agg(F.min(F.struct("at", "_p")).alias("_f"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("_f")) - 1).select(key, "url", F.col("pos").cast("bigint").alias("pos"))


def window_words(context: Column, system_words: Column) -> Column:
    """Words of a page that a model's window holds, in round thousands; at least one thousand."""
    room = (context - MAX_TOKENS - F.lit(WINDOW_TOKENS_PER_WORD) * (system_words + HEADER_WORDS)) / F.lit(WINDOW_TOKENS_PER_WORD)
    return F.greatest(F.lit(1000), (F.floor(room.cast("bigint") / 1000) * 1000)).cast("bigint")


def first_words(text: Column, most: Column) -> Column:
    """The first ``most`` words, line breaks kept."""
    words = F.regexp_extract_all(text, F.lit(r"\s*\S+"), 0)
    return F.when(F.size(words) > most, F.ltrim(F.array_join(F.slice(words, F.lit(1), most.cast("int")), ""))).otherwise(text)


def part_budget(target: Column, points: Column) -> dict[str, Column]:
    """Words of the short form, and of each point."""
    short = F.greatest(F.lit(20), F.least(F.lit(40), F.bround(target.cast("double") * 0.25).cast("int")))
    return {"short": short.cast("bigint"), "each": F.greatest(F.lit(10), F.bround((target - short).cast("double") / points).cast("int")).cast("bigint")}


def classify(text: Column, thread_posts: Column, article: Column, long_chars: int = LONG_CHARS, web: Column | None = None) -> Column:
    found = F.when(web, "web") if web is not None else F
    return found.when(article, "article").when(thread_posts > 1, "thread").when(F.length(text) > long_chars, "long").otherwise("post")


def summary_budget(words: Column) -> dict[str, Column]:
    """Words a summary may have, its points and the words of its short form."""
    size = F.greatest(F.lit(60), F.least(F.lit(400), F.bround(words.cast("double") * 0.2).cast("int")))
    points = F.greatest(F.lit(3), F.least(F.lit(10), F.bround(words.cast("double") / 150).cast("int")))
    return {"size": size.cast("bigint"), "points": points.cast("bigint"), "short": F.greatest(F.lit(20), F.least(F.lit(40), F.bround(size * 0.25).cast("int"))).cast("bigint")}


def small_picture(url: Column) -> Column:
    """The small form of a picture that X serves: other sizes out of its query; any other address as it is."""
    base, asked = F.substring_index(url, "?", 1), F.when(F.contains(url, F.lit("?")), F.regexp_extract(url, r"\?(.*)$", 1)).otherwise("")
    kept = F.filter(F.split(asked, "&"), lambda p: (p != "") & ~F.startswith(p, F.lit("name=")))
    return F.when(url.rlike("(?i)^https://pbs\\.twimg\\.com/"), F.concat(base, F.lit("?"), F.array_join(F.concat(kept, F.array(F.lit("name=small"))), "&"))).otherwise(url)
