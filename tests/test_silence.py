"""Silence over micro-batches: late rows, rows that are too late, sources that are forgotten."""

from pyspark.sql import functions as F

from feedloom.streaming import feeds, silence


def test_posts_come_out_when_their_place_is_certain(spark):
    folder = feeds.store_of(spark)
    schema = "source string, id string, at string"

    def run(rows, **options):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        posts = feeds.read_items(spark, f"{folder}/in", spark.createDataFrame([], schema).schema).withColumn("ts", F.to_timestamp("at"))
        out = feeds.run_once(silence.silence_stream(posts, "source", "ts", "id", "1 hour", "30 minutes", horizon="10 days"), folder=f"{folder}/out")
        return sorted((r.source, r.id, r.after_silence) for r in out.collect())

    day = lambda h, m=0, d=1: f"2024-01-{d:02d} {h:02d}:{m:02d}:00"
    # c would follow a silence of two hours; only a is behind the watermark of 11:50
    first = run([("s", "a", day(10)), ("s", "c", day(12)), ("t", "x", day(12, 20)), (None, "n", day(9)), ("s", "u", None)])
    assert first == [("s", "a", False)]
    # b comes late and ends the silence before c; w is too late to count
    second = run([("s", "b", day(11, 55)), ("s", "w", day(11, 30)), ("s", "d", day(14)), ("s", "d", day(14)), ("t", "y", day(13, 45))])
    assert second == [("s", "a", False), ("s", "b", True), ("s", "c", False), ("t", "x", False)]
    third = run([("z", "q", day(0, d=20))])
    assert third == sorted(second + [("s", "d", True), ("s", "d", True), ("t", "y", True)])
    # by now s and t are forgotten, so their next posts follow no silence
    run([("z", "r", day(0, d=21))])
    fifth = run([("s", "e", day(1, d=21)), ("z", "v", day(9, d=21))])
    assert ("s", "e", False) in run([("z", "o", day(9, d=22))]) and len(fifth) >= len(third)


def test_one_call_of_the_store_a_batch():
    """A source's rows are held by one call, however many there are."""
    import pandas as pd

    calls = []

    class State:
        def __getattr__(self, name):
            return lambda *args: calls.append(name)

    class Handle(State):
        def getValueState(self, *args):
            return State()

        getListState = getMapState = getValueState

    processor = silence.Silence(1, None, None, [])
    processor.init(Handle())
    frame = pd.DataFrame({"micros": range(1000, 2000), "post": ["p"] * 1000})
    assert list(processor.handleInputRows(("s",), iter([frame, frame]), None)) == []
    assert calls == ["appendList", "registerTimer"]
