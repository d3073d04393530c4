"""Timelines by backend, as a stream with restarts, and look-ups whose ids are pushed down."""

import json

import pytest

from feedloom.sources import backends, timeline
from feedloom.streaming import feeds


def record(folder, name, *pages):
    (folder / name).mkdir(parents=True, exist_ok=True)
    for n, page in enumerate(pages):
        (folder / name / f"{n}.json").write_text(json.dumps(page if isinstance(page, dict) else {"posts": [{"id": str(i)} for i in page]}))


class Backwards(backends.ByPost):
    """A backend of a user's own."""

    def page(self, handle, cursor):
        return super().page(handle[::-1], cursor)


def test_backends_are_found_by_name(spark, tmp_path):
    timeline.register(spark)
    record(tmp_path, "anna", [3, 2])
    record(tmp_path, "17", [9])
    (tmp_path / "users.json").write_text(json.dumps({"Bob": 17, "eve": 18}))
    read = lambda **o: sorted((r.handle, json.loads(r.post)["id"] if r.post else r.failed, r.not_found) for r in spark.read.format("timelines").options(path=f"file://{tmp_path}", **o).load().collect())
    assert read(handles="anna,bob") == [("anna", "2", None), ("anna", "3", None), ("bob", "status 404", True)]
    assert read(handles="anna,bob,eve", backend="by-call") == [("anna", "status 404", True), ("bob", "9", None), ("eve", "status 404", True)]
    assert [r[:2] for r in read(handles="17,71", backend="tests.test_timelines:Backwards")] == [("17", "status 404"), ("71", "9")]
    assert "no backend 'other'" in read(handles="x", backend="other")[0][1]


def test_each_backend_tries_again_what_passes():
    def failing(status, times):
        left = [status] * times

        def call():
            if left:
                raise timeline.Refused(left.pop())
            return timeline.Page([])

        return call

    quiet = lambda s: None
    for tries, status, most in ((backends.ByPost.tries, 429, 4), (backends.ByCall.tries, 429, 4), (backends.ByCall.tries, 503, 2), (backends.ByPost.tries, 503, 0), (backends.ByCall.tries, 403, 0)):
        assert timeline.asked_again(failing(status, most), tries, quiet).posts == []
        with pytest.raises(timeline.Refused):
            timeline.asked_again(failing(status, most + 1), tries, quiet)


def test_a_stream_reads_nothing_twice(spark, tmp_path):
    timeline.register(spark)
    folder = feeds.store_of(spark)
    options = {"path": f"file://{tmp_path}", "handles": "anna,bob,carl"}

    def run():
        """A new reader on the old checkpoint: as after a restart."""
        rows = spark.readStream.format("timelines").options(**options).load()
        return sorted((r.handle, json.loads(r.post)["id"]) for r in feeds.run_once(rows, folder=folder).collect())

    record(tmp_path, "anna", [12, 11], [10])
    record(tmp_path, "bob", {"status": 500})
    first = [("anna", "10"), ("anna", "11"), ("anna", "12")]
    assert run() == first
    assert run() == first
    record(tmp_path, "anna", [15, 14, 13], [12, 11], [10])
    record(tmp_path, "bob", [7, 6])
    second = sorted([*first, ("anna", "13"), ("anna", "14"), ("anna", "15"), ("bob", "6"), ("bob", "7")])
    assert run() == second
    record(tmp_path, "bob", [8, 7, 6])
    record(tmp_path, "carl", [1])
    assert run() == sorted([*second, ("bob", "8"), ("carl", "1")])


def test_an_account_that_fails_keeps_its_cursor():
    asked = {"a": [5], "b": [9]}
    reader = timeline.Follower({"handles": "a,b"})
    reader._newest = lambda h: max(asked[h]) if asked[h] else None
    start = reader.latestOffset()
    asked |= {"a": [6], "b": []}
    end = reader.latestOffset()
    assert (start, end) == ({"a": "5", "b": "9"}, {"a": "6", "b": "9"})
    assert [(p.handle, p.after, p.until) for p in reader.partitions(start, end)] == [("a", 5, 6)]
    again = timeline.Follower({"handles": "a,b"})
    again._newest = reader._newest
    assert again.latestOffset() == {"a": "6"}
    assert [(p.handle, p.after, p.until) for p in again.partitions(start, {"a": "6"})] == [("a", 5, 6)] and again.latestOffset() == {"a": "6", "b": "9"}


def test_ids_are_pushed_into_a_look_up(spark, tmp_path, capsys):
    timeline.register(spark)
    (tmp_path / "posts").mkdir()
    for i in range(0, 450, 2):
        (tmp_path / "posts" / f"{i}.json").write_text(json.dumps({"id": str(i), "text": f"t{i}"}))
    posts = lambda: spark.read.format("posts").option("path", str(tmp_path)).load()  # noqa: E731 - a table is read for one question
    some = posts()
    some = some.where(some.id.isin([str(i) for i in range(450)]))
    assert sorted(int(r.id) for r in some.collect()) == list(range(0, 450, 2)) and some.rdd.getNumPartitions() == 3
    one = posts().where("id = '4' and post like '%t4%'")
    one.explain("formatted")
    assert "PushedFilters: [EqualTo(id,4)]" in capsys.readouterr().out
    assert [json.loads(r.post)["text"] for r in one.collect()] == ["t4"]
    with pytest.raises(Exception, match="filter on id"):
        posts().collect()
