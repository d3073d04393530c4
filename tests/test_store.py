"""Stored posts by day, and pages published with their cursor."""

import os

import pytest
from pyspark.sql import functions as F

from feedloom.plans.numbering import content_digest
from feedloom.sources import pictures, publish, store
from feedloom.streaming import feeds

ROW = "id string, text string, fetched_at timestamp_ntz"


def rows(spark, *found):
    return spark.createDataFrame([(i, t, None) for i, t, _ in found], "id string, text string, at string").drop("at").join(
        spark.createDataFrame([(i, t, a) for i, t, a in found], "id string, text string, a string"), ["id", "text"]
    ).select("id", "text", F.col("a").cast("timestamp_ntz").alias("fetched_at"))


def files(path):
    at = path.removeprefix("file://")
    return {d: sorted(f for f in os.listdir(f"{at}/{d}") if f.endswith(".parquet")) for d in sorted(os.listdir(at)) if d.startswith("day=")}


def held(spark, path):
    return sorted((r.id, r.text) for r in store.opened(spark, path).collect())


def test_only_days_that_change_are_written_again(spark):
    path = feeds.store_of(spark)
    day = lambda d, h=8: f"2024-03-{d:02d} {h:02d}:00:00"
    assert store.forget(spark, path, day(1)) == store.compact(spark, path) == 0
    first = rows(spark, ("a", "1", day(1)), ("b", "1", day(2)), ("c", "1", day(2, 9)), ("d", "1", day(3)), ("e", "1", None))
    assert store.add_items(first, path) == 5 and store.add_items(first, path) == 0
    begun = files(path)
    # a known id changes nothing, of a new one the first stays; only its day gets a file
    assert store.add_items(rows(spark, ("a", "9", day(3)), ("f", "2", day(3, 10)), ("f", "1", day(3, 9)), (None, "x", day(1))), path) == 1
    added = files(path)
    assert {d for d in added if added[d] != begun.get(d)} == {"day=2024-03-03"} and set(begun["day=2024-03-03"]) < set(added["day=2024-03-03"])
    assert held(spark, path) == [("a", "1"), ("b", "1"), ("c", "1"), ("d", "1"), ("e", "1"), ("f", "1")]
    # an upsert that moves a row: the day it leaves and the day it comes to
    assert store.replace_items(rows(spark, ("d", "2", day(4)), ("f", "2", day(3, 9))), path) == 2
    moved = files(path)
    assert {d for d in moved if moved[d] != added.get(d)} == {"day=2024-03-03", "day=2024-03-04"}
    assert held(spark, path) == [("a", "1"), ("b", "1"), ("c", "1"), ("d", "2"), ("e", "1"), ("f", "2")]
    # whole days go unread, the day in question is written again, rows without a time stay
    assert store.forget(spark, path, day(2, 9)) == 2
    left = files(path)
    assert {d for d in moved if moved[d] != left.get(d)} == {"day=2024-03-01", "day=2024-03-02"} and "day=2024-03-01" not in left
    assert held(spark, path) == [("c", "1"), ("d", "2"), ("e", "1"), ("f", "2")]
    assert store.forget(spark, path, day(2, 9)) == 0 and files(path) == left
    assert [r.id for r in store.since(spark, path, F.lit(day(4)).cast("timestamp_ntz")).collect()] == ["d"]
    # a day that loses its last row has no folder any more
    assert store.replace_items(rows(spark, ("d", "3", day(5))), path) == 2 and "day=2024-03-04" not in files(path)


def test_days_of_many_files_are_compacted(spark):
    path = feeds.store_of(spark)
    for i in range(4):
        store.add_items(rows(spark, (f"x{i}", "t", "2024-03-01 08:00:00")), path)
    store.add_items(rows(spark, ("y", "t", "2024-03-02 08:00:00")), path)
    before = files(path)
    assert store.compact(spark, path, 3) == 1
    after = files(path)
    assert len(before["day=2024-03-01"]) == 4 and len(after["day=2024-03-01"]) == 1 and after["day=2024-03-02"] == before["day=2024-03-02"]
    assert len(held(spark, path)) == 5 and store.compact(spark, path, 3) == 0


def test_a_page_and_its_cursor_are_published_together(spark):
    folder = feeds.store_of(spark)
    assert publish.current(spark, folder) == publish.Published(0, None, None)
    pages = spark.createDataFrame([("full", 2, "b"), ("full", 1, "a"), ("quick", 1, "q")], "name string, at int, line string")
    first = publish.publish_pages(pages, folder, "10:00")
    assert (first.version, first.cursor) == (1, "10:00")
    read = lambda p: [r.value for r in spark.read.text(f"{p.folder}/name=full").collect()]
    assert read(first) == ["a", "b"]

    # killed between the page and the cursor: the old page and cursor stand, and nothing of the new one is left
    def dies(version, before):
        pages.select("name", "line").write.partitionBy("name").text(version)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        publish.publish(spark, folder, "11:00", dies)
    assert publish.current(spark, folder) == first and read(first) == ["a", "b"] and publish.tidy(spark, folder) == 0

    # of two runs from the same version one commits
    def slow(version, before):
        assert before == first
        publish.publish_pages(pages.where("at = 1"), folder, "11:30")

    with pytest.raises(publish.Conflict):
        publish.publish(spark, folder, "11:00", slow)
    second = publish.current(spark, folder)
    assert (second.version, second.cursor, read(second)) == (2, "11:30", ["a"])
    os.makedirs(f"{folder.removeprefix('file://')}/versions/3-dead")
    assert publish.tidy(spark, folder, keep=1) == 2 and read(publish.current(spark, folder)) == ["a"]


def test_fingerprints_are_asked_for_where_words_collide(spark):
    posts = spark.createDataFrame([(1, "w", ["a"]), (2, "w", ["b"]), (3, "v", ["c"]), (4, "w", []), (5, None, ["d"]), (6, "w", ["lost"]), (7, None, []), (8, "w", ["a", "b"]), (9, "u", ["e"]), (10, "u", ["e"])], "pos int, words string, images array<string>")
    stored = spark.createDataFrame([("v", ["x"]), ("t", ["y"])], "words string, images array<string>")
    asked = []

    def look_up(urls):
        asked.extend(r.url for r in urls.collect())
        return spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("x", "2"), ("d", "1"), ("e", "1")], "url string, digest string")

    new, old = pictures.told_apart(posts, stored, look_up)
    key = {r.pos: r.key for r in new.collect()}
    assert sorted(asked) == ["a", "b", "c", "lost", "x"]
    assert key[1] == key[2] and key[3] == [r.key for r in old.where("words = 'v'").collect()][0] and key[9] == key[10] and key[7] is None
    assert len({key[k] for k in (1, 3, 4, 5, 6, 8, 9)}) == 7


def test_a_digest_hangs_on_content_and_order_alone(spark):
    rows = spark.range(1000).selectExpr("id", "cast(id * 7 % 13 as string) as line")
    of = lambda df, **o: tuple(content_digest(df, [F.col("id")], F.col("line"), **o).first())
    one = of(rows.coalesce(1), fan=10)
    assert one == of(rows.repartition(50), fan=10) and one[0] == 1000
    assert one[1] != of(rows.where("id <> 500"), fan=10)[1] and one[1] != of(rows.selectExpr("999 - id as id", "line"), fan=10)[1]
    assert of(rows.limit(0)) == (0, "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")
