"""Semantic cases of the rules, on rows made by hand."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedloom.functions import text as X
from feedloom.operators import brief, posts, reading, render, stories, verify
from feedloom.sources import exports, follow, timeline
from feedloom.sources.feed import TIMELINE, timeline_items

DAY = datetime(2026, 7, 8, 6)


@pytest.mark.parametrize(
    "comment, original, echo",
    [
        ("Same words", "same   WORDS", True), ("", "x", False), ("lol", "lol that is true", False), ("a" * 120, "a" * 200, True), ("a" * 90, "a" * 200, False),
        ("the first twenty letters…", "the first twenty letters and more", True), ("a…", "abc", False), ("one https://t.co/x", "one", True), ("a &gt; b", "a > b", True),
    ],
)
def test_echo(spark, comment, original, echo):
    assert spark.range(1).select(X.is_echo(F.lit(comment), F.lit(original))).first()[0] is echo


@pytest.mark.parametrize("said, text", [(True, "an ad here"), (True, "#ads"), (False, "made"), (False, "éad"), (True, "AD")])
def test_keyword_from_word_start(spark, said, text):
    assert spark.range(1).select(X.mentions(F.lit(text), "ad")).first()[0] is said


def test_capital_is_one_letter(spark):
    cases = {"ß": "ẞ", "a": "A", "é": "É", "ᾀ": "ᾈ", "ῳ": "ῼ", "ŉ": "ŉ", "ﬁ": "ﬁ", "ẞ": "ẞ", "1": "1", "": ""}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r.c: r.u for r in df.select("c", X.capital(F.col("c")).alias("u")).collect()} == cases


def test_silence_is_strict_and_ignores_equal_times(spark):
    rows = [("a", DAY), ("a", DAY), ("a", DAY + timedelta(days=15)), ("b", DAY), ("b", DAY + timedelta(days=15, minutes=1))]
    df = spark.createDataFrame(rows, "source string, published timestamp_ntz")
    found = posts.silence(df, "source", "published", "15 days").where("after_silence").collect()
    assert [(r.source, r.published) for r in found] == [("b", DAY + timedelta(days=15, minutes=1))]


def test_duplicates_and_repeats(spark):
    batch = spark.createDataFrame([("k", "1", 1), ("k", "2", 2), ("s", "3", 3), ("s2", "9", 4), (None, "5", 5)], "key string, status string, pos int")
    stored = spark.createDataFrame([("s", "4"), ("s2", "9")], "key string, status string")
    got = {r.pos: r.outcome for r in posts.duplicates(batch, stored).collect()}
    assert got == {1: "kept", 2: "duplicates", 3: "repeats", 4: "kept", 5: "kept"}


def test_take_while_loses_newer_rows_after_an_old_one(spark):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, False), ("b", 1, True)], "s string, p int, old boolean")
    kept = posts.take_while(df, "s", F.col("p"), F.col("old"))
    assert [(r.s, r.p) for r in kept.collect()] == [("a", 1)]
    both = posts.with_fallback(kept, df, "s", [F.col("p")])
    assert {(r.s, r.p) for r in both.collect()} == {("a", 1), ("b", 1)}


def _items(spark, rows):
    made = [(str(i), s, t, d, [], "", "", "") for i, (s, t, d) in enumerate(rows)]
    df = spark.createDataFrame(made, "id string, source string, full_text string, published timestamp_ntz, images array<string>, text string, retweet_of_author string, retweet_of_text string")
    return posts.with_words(df.withColumn("grp", F.lit("")))


def test_stories_never_chain(spark):
    a = "alpha bravo charlie delta echoes foxtrot"
    b = "delta echoes foxtrot golfing hotels indigo"
    c = "golfing hotels indigo juliet kilogram limabean"
    ab, bc = "charlie delta echoes foxtrot golfing", c
    rows = [("@a", a, DAY), ("@b", a, DAY + timedelta(minutes=1)), ("@c", c, DAY + timedelta(minutes=2)), ("@d", b, DAY + timedelta(minutes=3)), ("@e", "too short", None)]
    assert ab and bc
    got = {r.id: r.leader for r in stories.stories(_items(spark, rows)).collect()}
    assert got["1"] == "0" and got["2"] == "2" and "4" not in got


def test_words_are_made_once(spark):
    """Words of four letters or more, whatever the script; the filter on their number doesn't make them anew."""
    rows = stories.worded(_items(spark, [("@a", "The 2024 naïve Łódź straße с Москвой abc this 𝒳𝒳𝒳 𝒳𝒳𝒳𝒳 x1y2 x1y2 https://t.co/words", DAY), ("@b", "only four words here now", DAY)]))
    assert [(r.id, r.toks) for r in rows.collect()] == [("0", sorted(["2024", "naïve", "łódź", "straße", "москвой", "𝒳𝒳𝒳𝒳", "x1y2"]))]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1


def test_pairs_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    words = [f"word{i}" for i in range(40)]
    rows = [("@a", " ".join(rng.choices(words, k=rng.randint(5, 14))), DAY + timedelta(minutes=i)) for i in range(120)]
    sets = stories.token_sets(_items(spark, rows)).collect()
    expect = set()
    for x in sets:
        for y in sets:
            i = len(set(x.toks) & set(y.toks))
            if x.at < y.at and i >= 3 and i / len(set(x.toks) | set(y.toks)) >= 0.4:
                expect.add((x.cls, y.cls))
    found = {(r.a, r.b) for r in stories.pairs(stories.token_sets(_items(spark, rows))).collect()}
    assert found == expect and expect


def test_pairs_of_many_blocks_equal_brute_force(monkeypatch):
    """Blocks of a few sets, tables of a few cells, sizes far apart, equal times and no time at all."""
    import random

    import pyarrow as pa

    from feedloom.operators import overlap

    monkeypatch.setattr(overlap, "BLOCK_SETS", 7)
    monkeypatch.setattr(overlap, "CELLS", 16)
    rng = random.Random(3)
    sets = sorted(({(rng.randint(0, 30) - 15) * (1 << 55) for _ in range(rng.choice([5, 8, 12, 40]))} for _ in range(90)), key=len)
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(90)]), pa.array([None] * 90, pa.timestamp("us")), pa.array([sorted(s) for s in sets], pa.list_(pa.int64()))], ["cls", "at", "words"])
    rows = [b.to_pylist()[0] for b in overlap._blocks(iter([batch.slice(0, 50), batch.slice(50)]))]
    assert len(rows) == 13
    sides, found = [overlap._Side(r, 0.4) for r in rows], set()
    for p, x in enumerate(sides):
        for q in range(p, len(sides)):
            y = sides[q]
            for i, j, c in zip(*overlap._alike(x, y, p == q, 0.4, 3)):
                found.add((int(x.cls[i]), int(y.cls[j]), int(c)))
    both = lambda a, b: len(sets[a] & sets[b])
    assert found == {(a, b, both(a, b)) for a in range(90) for b in range(a + 1, 90) if both(a, b) >= 3 and both(a, b) / len(sets[a] | sets[b]) >= 0.4}
    assert {a // 7 == b // 7 for a, b, _ in found} == {True, False}  # pairs of one block and of two


def test_few_words_are_looked_up_for_sets_of_known_sizes(monkeypatch):
    """What alike sets share is known from their sizes, so few words of the smaller one are looked up; all pairs are found."""
    import numpy as np
    import pyarrow as pa

    from feedloom.operators import overlap

    rng, looked_up, spread = np.random.default_rng(4), [], overlap._spread
    monkeypatch.setattr(overlap, "_spread", lambda starts, sizes: looked_up.append(int(sizes.sum())) or spread(starts, sizes))
    # The larger the number, the more frequent the word.
    chance = np.arange(1, 4001) ** 3.0
    drawn = lambda n: set(rng.choice(4000, n, False, chance / chance.sum()).tolist())
    small, large = [drawn(50) for _ in range(150)], [drawn(110) for _ in range(120)]
    large += [s | set(range(4000 + 60 * k, 4060 + 60 * k)) for k, s in enumerate(small[:30])]
    sides = []
    for sets in (small, large):
        batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(150)]), pa.array([None] * 150, pa.timestamp("us")), pa.array([sorted(s) for s in sets], pa.list_(pa.int64()))], ["cls", "at", "words"])
        sides += [overlap._Side(b.to_pylist()[0], 0.4) for b in overlap._blocks(iter([batch]))]
    found = {(int(i), int(j), int(c)) for i, j, c in zip(*overlap._alike(*sides, False, 0.4, 3))}
    both = lambda a, b: len(small[a] & large[b])
    assert found == {(a, b, both(a, b)) for a in range(150) for b in range(150) if both(a, b) / len(small[a] | large[b]) >= 0.4} and len(found) >= 30
    assert sum(looked_up) < 30000, sum(looked_up)


def test_pairs_of_blocks_of_like_sizes_equal_brute_force(spark, monkeypatch):
    """Sizes far apart, so many blocks; the order of words comes from their counts in slots, which words share."""
    import random

    from feedloom.operators import overlap

    rng = random.Random(8)
    said = [[f"word{int(400 * rng.random() ** 2)}" for _ in range(rng.choice([6, 9, 14, 30, 80]))] for _ in range(100)]
    said += [s[: len(s) * 2 // 3] + [f"other{k}", f"others{k}"] for k, s in enumerate(said[:40])]
    found = {}
    for slots, ratio in ((overlap.SLOTS, overlap.RATIO), (64, 1.0)):
        monkeypatch.setattr(overlap, "SLOTS", slots)
        monkeypatch.setattr(overlap, "RATIO", ratio)
        items = _items(spark, [("@a", " ".join(s), DAY + timedelta(minutes=i)) for i, s in enumerate(said)])
        found[slots] = {(r.a, r.b) for r in stories.pairs_of(items).collect()}
    sets = stories.token_sets(items).collect()
    both = lambda x, y: len(set(x.toks) & set(y.toks))
    expect = {(x.cls, y.cls) for x in sets for y in sets if x.at < y.at and both(x, y) >= 3 and both(x, y) / len(set(x.toks) | set(y.toks)) >= 0.4}
    assert all(f == expect for f in found.values()) and len(expect) >= 30


def test_pairs_are_never_shuffled(spark):
    rows = [("@a", "charlie delta echoes foxtrot golfing", DAY), ("@b", "charlie delta echoes foxtrot hotels", None), ("@c", "charlie delta echoes foxtrot hotels indigo", None)]
    found = stories.pairs(stories.token_sets(_items(spark, rows)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    assert {(r.a, r.b) for r in found.collect()} == {("0", "1"), ("0", "2"), ("1", "2")}


def test_words_of_copies_are_in_no_shuffle_but_one(spark, monkeypatch):
    """Copies are told by their digests; a bit map that lets all pass gives the same pairs and stories."""
    from feedloom.plans import bitmap

    a, b = "charlie delta echoes foxtrot golfing", "charlie delta echoes foxtrot hotels"
    rows = [("@a", a, DAY + timedelta(minutes=9)), ("@b", b, None), ("@c", a, DAY), ("@d", b, None), ("@e", a, None), ("@f", "juliet kilogram limabean mangos november", DAY)]
    hashed = stories.hashed(stories.worded(_items(spark, rows)))
    assert stories._hashed_sets(hashed).columns == ["key", "cls", "at"]
    for bits in (bitmap.BITS, 1):
        monkeypatch.setattr(bitmap, "BITS", bits)
        passed = stories._with_words(hashed, stories._hashed_sets(hashed))
        assert passed.count() == (3 if bits > 1 else 6)
        assert [(r.a, r.b, round(r.score, 9)) for r in stories.pairs(passed).collect()] == [("2", "1", round(4 / 6, 9))]
        assert {r.id: r.leader for r in stories.stories(_items(spark, rows)).collect()} == {"0": "2", "1": "2", "2": "2", "3": "2", "4": "2", "5": "5"}


def test_stories_leave_no_words_and_story_lines_cut_texts_first(spark):
    from pathlib import Path

    from feedloom.plans.lineage import shared_folder

    said = ["alpha bravo charlie delta echos", "alpha bravo charlie delta echos foxtrot", "other words stand alone here " + "and long " * 99]
    folder = Path(shared_folder(spark).removeprefix("file:"), "feedloom")
    before = set(folder.glob("*"))
    members = stories.stories(_items(spark, [("@a", text, DAY + timedelta(minutes=i)) for i, text in enumerate(said)]))
    assert {r.id: r.leader for r in members.collect()} == {"0": "0", "1": "0", "2": "2"}
    columns = [set(spark.read.parquet(f"file://{p}").columns) for p in set(folder.glob("*")) - before]
    assert columns and not any(c & {"words", "codes"} for c in columns)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
    texts = spark.createDataFrame([(str(i), text) for i, text in enumerate(said)], "leader string, text string")
    cut = {r.leader: r.about for r in render.abouts(members.where("id = '2'").select("leader"), texts).collect()}
    assert set(cut) == {"2"} and len(cut["2"]) <= render.SNIPPET + 1



def test_places_within_a_group_come_from_ranges(spark):
    from feedloom.plans.numbering import numbered_within

    rows = [(g, (i * 37) % 100) for g in ("a", "b", None) for i in range(100)]
    placed = numbered_within(spark.createDataFrame(rows, "g string, at int").repartition(3), [F.col("g")], [F.col("at")], "place")
    assert sorted((r.g or "", r.at, r.place) for r in placed.collect()) == sorted((g or "", at, at + 1) for g, at in rows)


def test_support_of_numbers(spark):
    items = spark.createDataFrame([(1, "Big sum: $4.2 billion and 35", "Mentions 7 by @alice, SEC and NASA. Then Hacks by (Robert) in Paris", [1])], "item int, headline string, detail string, ids array<bigint>")
    rows = spark.createDataFrame([(1, "it made $4.2 billion, 1,357 people, says @Alice of the sec, who hacked it with robert")], "n bigint, text string")
    r = verify.support(items, rows).first()
    assert (r.facts, r.unsupported_facts, r.names, r.unsupported_names) == (4, 2, 5, 2)


def test_self_chain_takes_the_least_reply(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 1, "a"), (3, 1, "a"), (4, 2, "b"), (5, 2, "a")], "id bigint, parent bigint, author string")
    assert [(r.id, r.depth) for r in reading.self_chain(df).orderBy("depth").collect()] == [(1, 1), (2, 2), (5, 3)]


def test_timeline_items(spark):
    page = '{"id":"7","text":"thanks","createdAt":"Tue Dec 10 07:00:30 +0000 2024","isReply":true,"inReplyToUsername":"Bob","conversationId":"5","author":{"userName":"bob"},"extendedEntities":{"media":[{"media_url_https":"u"},{"media_url_https":"u"}]}}'
    rows = spark.createDataFrame([(page,)], "j string").select(F.from_json("j", TIMELINE).alias("x")).select("x.*")
    r = timeline_items(rows).first()
    assert (r.title, r.thread_root, r.images, r.published) == ("R to @Bob: thanks", "5", ["u"], datetime(2024, 12, 10, 7, 0, 30))


def test_self_chain_of_150_posts(spark):
    """Longer than recursive queries go by default."""
    rows = [(i, i - 1 if i else None, "a") for i in range(150)] + [(1000, 0, "a"), (1001, 5, "b"), (2000, None, "b")]
    got = reading.self_chain(spark.createDataFrame(rows, "id bigint, parent bigint, author string")).collect()
    assert sorted((r.root, r.id, r.depth) for r in got) == [(0, i, i + 1) for i in range(150)] + [(2000, 2000, 1)]
    short = reading.self_chain(spark.createDataFrame(rows, "id bigint, parent bigint, author string"), most=3).collect()
    assert sorted(r.id for r in short) == [0, 1, 2, 2000]


def test_small_runs_are_no_truncation_suspects(spark):
    rows = [("a", 1000, 250), ("b", 900, 230), ("c", 800, 200), ("cut", 950, 100), ("small", 100, 10), ("none", 990, 0)]
    told = lambda rows: [r.id for r in verify.truncation_suspects(spark.createDataFrame(rows, "id string, chars int, tokens int")).collect()]
    assert told(rows) == ["cut"]
    assert told([rows[0], rows[3], ("s1", 10, 5), ("s2", 10, 5)]) == []


def test_reply_cut_off_is_read_as_far_as_it_goes(spark):
    whole = '{"items": [{"headline": "A", "detail": "one two", "ids": [1, 2]}]}'
    cut = r'{"items": [{"headline": "A \"b\"", "detail": "one two", "ids": [1, 2]}, {"headline": "C", "detail": "thr'
    rows = verify.reply_items(spark.createDataFrame([(0, whole), (1, cut), (2, "nothing")], "chunk int, raw string")).collect()
    got = {(r.chunk, r.item): (r.headline, r.detail, r.ids) for r in rows}
    assert got == {(0, 0): ("A", "one two", [1, 2]), (1, 0): (r'A \"b\"', "one two", [1, 2]), (1, 1): ("C", None, None)}
    items = verify.reply_items(spark.createDataFrame([(1, cut)], "chunk int, raw string"))
    stats = verify.chunk_stats(items, spark.createDataFrame([(1, 1), (1, 5)], "chunk int, n int")).first()
    assert (stats["items"], stats.ids_per_item, stats.max_ids, stats.cited, stats.valid, stats.coverage) == (2, 2.0, 2, 2, 1, 0.5)


# -- shared retweets ------------------------------------------------------------------------------


def _shared(spark, rows):
    made = [(str(i), a, own, DAY + timedelta(minutes=i), by, text) for i, (a, own, by, text) in enumerate(rows)]
    return spark.createDataFrame(made, "id string, author string, own string, published timestamp_ntz, retweet_of_author string, retweet_of_text string")


def test_shared_retweets_without_any_group(spark):
    items = _shared(spark, [("a", "x", "Bob", "one post"), ("b", "", "Bob", "another post"), ("c", "own words", "", "")])
    assert stories.shared_retweets(items).collect() == []
    assert stories.in_no_group(items, stories.shared_retweets(items)).count() == 3


def test_shared_retweets_grow_to_the_longest_copy(spark):
    whole = "This is the whole text of a post that some of its copies cut off somewhere"
    rows = [("a", "", "Bob", whole[:40] + "…"), ("b", "mine", "@bob", whole), ("c", "", "BOB", whole.upper()), ("bob", whole, "", ""), ("d", "", "Eve", whole), ("e", "", "Bob", "something else altogether here")]
    items = _shared(spark, rows)
    found = stories.shared_retweets(items).collect()
    assert [(r.handle, r.author, r.text, r.n, r.ids, r.original) for r in found] == [("bob", "Bob", whole, 3, ["0", "1", "2"], "3")]
    assert sorted(r.id for r in stories.in_no_group(items, stories.shared_retweets(items)).collect()) == ["4", "5"]


def test_shared_retweets_equal_a_plain_loop(spark):
    import random

    rng = random.Random(11)
    base = ["a post about many things that goes on for quite a while " * 3, "a post about many things that ends", "short", "another post about many things, told at length " * 3]
    cut = lambda t: rng.choice([t, t[: rng.randrange(5, 130)] + "…", t[: rng.randrange(5, 130)], t.upper(), ""])
    rows = [(f"u{i}", "", rng.choice(["Bob", "@BOB", "eve"]), cut(rng.choice(base))) for i in range(80)]
    groups: list[list] = []
    form = lambda t: " ".join(t.lower().split())
    for i, (_, _, by, text) in enumerate(rows):
        who = by.lstrip("@").lower()
        g = next((g for g in groups if g[0] == who and stories._takes(form(text), form(g[1]))), None)
        if g is None:
            groups.append([who, text, [str(i)]])
        else:
            g[2].append(str(i))
            g[1] = max(g[1], text, key=len)
    got = {(r.handle, r.text, tuple(r.ids)) for r in stories.shared_retweets(_shared(spark, rows)).collect()}
    assert got == {(w, t, tuple(ids)) for w, t, ids in groups if len(ids) >= 2} and got


# -- threads --------------------------------------------------------------------------------------


def test_threads_go_up_and_down_and_stop_at_cycles(spark):
    rows = [(i, i - 1 if i else None, "a") for i in range(150)] + [(500, 3, "a"), (501, 4, "b"), (600, 601, "a"), (601, 600, "a"), (700, 9999, "a"), (800, 801, "c"), (801, None, "d")]
    df = spark.createDataFrame(rows, "id bigint, parent bigint, author string")
    saved = spark.createDataFrame([(4,), (500,), (600,), (700,), (800,)], "id bigint")
    got = {}
    for r in reading.thread_of(df, saved).collect():
        got.setdefault(r.saved, {})[r.place] = r.id
    assert [got[4][k] for k in sorted(got[4])] == list(range(150))
    assert got[500] == {1: 0, 2: 1, 3: 2, 4: 3, 5: 500}
    assert got[600] == {1: 601, 2: 600} and got[700] == {1: 700} and got[800] == {1: 800}
    short = reading.thread_of(df, spark.createDataFrame([(4,)], "id bigint"), most=7).collect()
    assert sorted((r.place, r.id) for r in short) == [(i + 1, i) for i in range(7)]


def test_links_keep_the_brackets_they_opened(spark):
    rows = [(1, "(see https://en.example.org/a_(b)), https://a.example.org/x). **https://b.example/y!** https://x.com/u http://localhost/ https://c.example/#p https://c.example/")]
    got = reading.links(spark.createDataFrame(rows, "k int, t string"), "k", F.col("t")).orderBy("pos").collect()
    assert [r.url for r in got] == ["https://en.example.org/a_(b)", "https://a.example.org/x", "https://b.example/y", "https://c.example/"]


# -- pages and markdown ---------------------------------------------------------------------------


def test_code_stays_as_it_is(spark):
    md = "Some <b>words</b>  [here](https://x.example)\n\n\n\n```\n<b>kept</b>  [as](it is)\n```\nand `<i>` too ![p](q)<script>no</script>"
    got = spark.range(1).select(X.clean_markdown(F.lit(md))).first()[0]
    assert "<b>kept</b>  [as](it is)" in got and "`<i>`" in got and "https://x.example" not in got and "<b>words" not in got and "no" not in got.split() and "\n\n\n" not in got


def test_every_entity(spark):
    rows = spark.createDataFrame([("&eacute;&amp;&nbsp;&#8217;x",), ("plain",), (None,)], "t string")
    assert [r[0] for r in rows.select(X.unescape(F.col("t"))).collect()] == ["é&\xa0’x", "plain", None]


@pytest.mark.parametrize(
    "text, md",
    [
        ("# not a *heading*", "\\# not a \\*heading\\*"), ("1. item", "1\\. item"), ("<img src=x> ![a](https://t.example/p.gif)", "&lt;img src=x&gt; !\\[a\\](https://t.example/p.gif)"),
        ("see https://a.example/_x_[y](b).", "see https://a.example/_x_%5By%5D(b)."), ("a &lt;b&gt;", "a &lt;b&gt;"),
    ],
)
def test_words_are_safe_in_markdown(spark, text, md):
    assert spark.range(1).select(render.words_md(F.lit(text))).first()[0] == md


# -- small files ----------------------------------------------------------------------------------


def test_follow_list(spark):
    text = "\ufeff// comment\nalice\n## Finance | level:high | hide:presale | reposts:off # more\nNewsFrank | name:Frank Wire | priority:high\n@gina | reposts:on | only:airdrop, \"#alpha, beta\"\nfocus: old\n## Chat | recap:on\nALICE | rp_off\nbob | Bob Name | hgih // end\n"
    with pytest.warns(UserWarning, match="line 9.*'hgih'"):
        rows = {r.handle: r for r in follow.sources(spark, text).collect()}
    assert set(rows) == {"alice", "NewsFrank", "gina", "bob"}
    frank, gina, bob = rows["NewsFrank"], rows["gina"], rows["bob"]
    assert (frank.name, frank.grp, frank.priority, frank.reposts, frank.level, frank.hide) == ("Frank Wire", "finance", True, False, "high", ["presale"])
    assert (gina.reposts, gina.only, gina.hide) == (True, ["airdrop", "#alpha, beta"], ["presale"]) and (bob.name, bob.recap, bob.grp) == ("Bob Name", True, "chat")


def test_settings_never_show_what_stands_there():
    with pytest.raises(follow.SettingError) as e:
        follow.settings("a: 1\nkey: [SECRET")
    assert "line" in str(e.value) and "SECRET" not in str(e.value)
    found = follow.settings("fetch:\n  most: 5\n  key: SECRET\n")
    assert follow.setting(found, "fetch.most", int) == 5 and follow.setting(found, "fetch.none", int, 7) == 7
    with pytest.raises(follow.SettingError, match="fetch.key must be int") as e:
        follow.setting(found, "fetch.key", int)
    assert "SECRET" not in str(e.value)
    assert follow.environment("export A='x y' # c\nB=2 # two\n#C=3\n", {"B": "own"}) == {"A": "x y", "B": "own"}
    assert follow.percent("30%") == 30 and follow.ratio("30%") == 0.3
    for wrong in (lambda: follow.ratio("30"), lambda: follow.percent("0"), lambda: follow.percent("x")):
        with pytest.raises(follow.SettingError):
            wrong()


def test_nothing_is_overwritten(tmp_path):
    (tmp_path / "a.md").write_text("x")
    (tmp_path / "a-2.md").write_text("x")
    assert follow.unused_name(tmp_path / "a.md").name == "a-3.md" and follow.unused_name(tmp_path / "b.md").name == "b.md"


# -- timelines ------------------------------------------------------------------------------------


def test_timelines_are_read_to_the_cutoff(spark, tmp_path):
    import json

    when = lambda h: f"2024-12-10T{h:02d}:00:00Z"
    pages = {
        "alice": [{"posts": [{"id": "1", "createdAt": when(9)}, {"id": "2"}]}, {"posts": [{"id": "3", "createdAt": when(1)}, {"id": "4", "createdAt": when(8)}]}],
        "bob": [{"posts": [{"id": "5", "createdAt": when(2)}]}], "carol": [{"posts": [{"id": "6", "createdAt": when(7)}]}, {"status": 500}], "dave": [{"status": 500}],
    }
    for handle, found in pages.items():
        (tmp_path / handle).mkdir()
        for n, page in enumerate(found):
            (tmp_path / handle / f"{n}.json").write_text(json.dumps(page))
    spark.dataSource.register(timeline.Timelines)
    options = {"path": str(tmp_path), "handles": "dave,alice,bob,carol,gone", "cutoff": "2024-12-10T06:00:00+00:00"}
    rows = spark.read.format("timelines").options(**options).load().orderBy("place", "pos").collect()
    got = [(r.handle, json.loads(r.post)["id"] if r.post else None, r.failed, r.not_found) for r in rows]
    assert got == [("dave", None, "status 500", False), ("alice", "1", None, None), ("alice", "2", None, None), ("bob", "5", None, None), ("carol", "6", None, None), ("gone", None, "status 404", True)]


def test_calls_are_paced_and_tried_again():
    waits, calls = [], iter([timeline.Refused(429), TimeoutError(), timeline.Refused(429), None])

    def call():
        e = next(calls)
        if e:
            raise e
        return timeline.Page([])

    assert timeline.asked_again(call, wait=waits.append).posts == [] and waits == [2.0, 4.0, 8.0]
    with pytest.raises(timeline.Refused):
        timeline.asked_again(lambda: (_ for _ in ()).throw(timeline.Refused(404)), wait=waits.append)
    now, slept = [0.0], []
    pace = timeline.Pace(60, clock=lambda: now[0], wait=slept.append)
    for _ in range(3):
        pace.step()
    assert slept == [1.25, 2.5]


def test_limits_of_a_fetch():
    assert [timeline.page_limit(m, 20) for m in (0, 10, 300)] == [25, 25, 30]
    assert timeline.item_ceiling(20, True, 24) == (40, False) and timeline.item_ceiling(0, True, 24) == (0, False) and timeline.item_ceiling(0, False, 24) == (100, True)
    assert timeline.lookback_hours(None, DAY) is None and timeline.lookback_hours(DAY - timedelta(hours=5), DAY) == 6 and timeline.lookback_hours(DAY - timedelta(days=30), DAY) == 169


# -- exports and runs -----------------------------------------------------------------------------


def test_unknown_number_is_an_error(spark):
    lines = spark.createDataFrame([(1, "# head"), (2, "## X"), (3, "### regular"), (4, "[1] @a hi there"), (5, "## repeated stories"), (6, "repeated: [1] [2]")], "at int, line string")
    mapping = spark.createDataFrame([(1, "regular", None, "")], "n bigint, tier string, words bigint, grp string")
    r = exports.checked(exports.parse_export(lines, mapping)).first()
    assert (r.n, r.section, r.line, r.words) == (1, "X", "@a hi there", 3) and exports.parse_repeated(lines).first().ns == [1, 2]
    with pytest.raises(Exception, match="post 1 is in the export but not in its map"):
        exports.checked(exports.parse_export(lines, mapping.limit(0))).collect()


def test_run_folder(spark, tmp_path):
    records = spark.createDataFrame([("b-02", True), ("a-01", False)], "chunk string, ok boolean")
    manifest = spark.createDataFrame([(["b-02", "a-01"], "m")], "chunks array<string>, model string")
    exports.write_run(records, manifest, str(tmp_path / "run"))
    told, rows = exports.read_run(spark, str(tmp_path / "run"), records.schema, manifest.schema)
    assert told.first().model == "m" and [r.chunk for r in rows.orderBy("place").collect()] == ["b-02", "a-01"]
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        exports.write_run(records, manifest, str(tmp_path / "run"))


def test_numbers_along_an_order(spark):
    from feedloom.plans.numbering import numbered_along

    df = spark.range(1000).withColumn("k", F.expr("id * 7919 % 1009"))
    got = numbered_along(df, [F.col("k")]).orderBy("k").collect()
    assert [r.n for r in got] == list(range(1, 1001))


def test_room_passes_over_what_does_not_fit(spark):
    ranked = spark.createDataFrame([(1, 3.0), (2, 9.0), (3, 4.0), (4, 2.0), (5, 3.0), (6, 1.0)], "rank bigint, cost double")
    assert [r["rank"] for r in brief.fill_room(ranked, 10.0).where("taken").orderBy("rank").collect()] == [1, 3, 4, 6]


def test_sessions_and_horizon(spark, tmp_path):
    from feedloom.streaming import feeds

    rows = [(1, "a", DAY), (2, "a", DAY + timedelta(hours=1)), (3, "a", DAY + timedelta(days=3)), (4, "b", DAY)]
    spark.createDataFrame(rows, "id int, u string, ts timestamp").write.parquet(str(tmp_path / "in"))
    read = lambda: feeds.read_items(spark, str(tmp_path / "in"), "id int, u string, ts timestamp", files_per_trigger=1)
    assert sorted((r.u, r.n) for r in feeds.run_once(feeds.sessions(read(), "ts", "u", "2 days"), "complete").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    late = read().withColumn("ts", F.when(F.col("id") == 4, F.col("ts") - F.expr("interval 90 days")).otherwise(F.col("ts")))
    got = sorted(r.id for r in feeds.run_once(feeds.first_sightings(late.repartition(1), "id", "ts", "1 day")).collect())
    assert set(got) <= {1, 2, 3, 4} and {3} <= set(got)


def test_a_brief_is_refitted(spark):
    shown = spark.createDataFrame([(i, "pictures" if i <= 3 else "line") for i in range(1, 9)], "rank bigint, shown string")
    weigh = lambda df: sum({"pictures": 1 + brief.PICTURE_LINES + 1, "line": 1, "link": 0}[r.shown] for r in df.collect())
    for target in (3, 8, 100):
        got = brief.refit(shown, target, weigh)
        assert weigh(got) <= target
    assert {r["rank"]: r.shown for r in brief.refit(shown, 12.5, weigh).collect()} == {1: "pictures", 2: "line", 3: "line"} | {i: "line" for i in range(4, 9)}


def test_pictures_tell_posts_alike(spark, tmp_path):
    from feedloom.sources import pictures

    for name, data in (("a.jpg", b"one"), ("b.jpg", b"one"), ("c.jpg", b"two")):
        (tmp_path / name).write_bytes(data)
    known = pictures.fingerprints(spark, str(tmp_path)).withColumn("url", F.element_at(F.split("path", "/"), -1))
    posts_ = spark.createDataFrame([(1, ["a.jpg", "c.jpg"]), (2, ["b.jpg", "c.jpg"]), (3, ["a.jpg", "gone.jpg"]), (4, [])], "pos int, images array<string>")
    got = {r.pos: r.pictures for r in pictures.by_digests(posts_, known).collect()}
    assert got[1] == got[2] and len(got[1]) == 65 and got[3] is None and got[4] == ""


def test_headings_of_shared_posts(spark):
    whole = "This is the whole text of a post that two share, with_marks"
    items = _shared(spark, [("a", "", "b_b", whole), ("c", "", "B_b", whole), ("b_b", whole, "", ""), ("d", "", "x", whole), ("e", "", "x", whole)])
    links = items.select("id", F.col("author").alias("source"), F.lit("u").alias("url"), "published")
    got = {r.handle: r.heading for r in render.shared_heading(stories.shared_retweets(items), links).collect()}
    assert got == {"b_b": "#### 🔁 b\\_b <!-- item:2 --> [Post Link](u) · 2026-07-08 06:02 UTC — retweeted 2 times", "x": "#### 🔁 @x — retweeted 2 times"}


def test_digest_folder(spark, tmp_path):
    posts_ = spark.createDataFrame([(2, "x/a", "regular", "[2] b"), (1, "x", "regular", "[1] a"), (3, "x/a", "recap", "[3] c")], "n bigint, section string, tier string, line string")
    rows = posts_.withColumns({"id": F.col("n").cast("string"), "url": F.lit("u"), "source": F.lit("@a"), "grp": F.lit(""), "words": F.lit(1)})
    exports.write_digest(rows, rows, exports.export_lines(posts_), str(tmp_path / "d"))
    parts = sorted((tmp_path / "d" / "export").glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    assert text == "\n## X\n### regular\n[1] a\n\n## X / a\n### regular\n[2] b\n### recap\n[3] c\n"
    assert spark.read.json(str(tmp_path / "d" / "map")).count() == 3


def test_cursor_of_a_consumer(spark, tmp_path):
    from feedloom.streaming import feeds

    store = str(tmp_path / "meta")
    assert feeds.cursor(spark, store, "digest") is None
    for value in ("2026-01-01", "2026-01-02"):
        feeds.advance(spark, store, "digest", value)
    feeds.advance(spark, store, "other", "x")
    assert feeds.cursor(spark, store, "digest") == "2026-01-02" and feeds.cursor(spark, store, "none") is None


def test_polling_adds_what_is_new(spark, tmp_path):
    from feedloom.streaming import feeds

    put = lambda ids: spark.createDataFrame([(i,) for i in ids], "id int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([1, 2])
    query = feeds.poll(feeds.read_items(spark, str(tmp_path / "in"), "id int"), feeds.append_new(str(tmp_path / "store")), str(tmp_path / "state"), seconds=1)
    try:
        query.processAllAvailable()
        put([2, 3])
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "store")).collect()) == [1, 2, 3]


def test_hints_number_posts_without_their_texts(spark):
    from feedloom import queries

    found = queries._numbered(spark, "/root/testdata/sf0.001", "id")
    assert {"id", "n", "source", "tier"} <= set(found.columns) and not {"own", "full_text", "retweet_of_text"} & set(found.columns)
