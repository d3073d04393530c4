"""Timelines of followed accounts as data sources: a table, a stream with a cursor an account, and look-ups of posts by id.

An account that fails, or isn't there, is a row that says why; the others go
on.  Register the sources with ``register(spark)``.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from feedloom.sources.backends import Backend, ByPost, Page, Refused, backend_of

# How far one account is read, and how failures are tried again.
PAGES, SAFETY_ITEMS, MOST_AT_ONCE = 25, 100, 10
FIRST_WAIT, PACE_MARGIN, SILENT_TRIES = 2.0, 1.25, 2
MAX_LOOKBACK_HOURS = 168


def page_limit(most: int, size: int) -> int:
    """Pages read of one account at most: twice what ``most`` items take, PAGES at least; PAGES if unlimited (0)."""
    return max(PAGES, 2 * math.ceil(most / size)) if most > 0 else PAGES


def item_ceiling(asked: int, billed_by_call: bool, max_age_hours: int) -> tuple[int, bool]:
    """Items fetched of one account at most (0: no limit), and whether that is only the safety limit."""
    if asked > 0:
        return 2 * asked, False
    unlimited = billed_by_call and max_age_hours > 0
    return (0, False) if unlimited else (SAFETY_ITEMS, True)


def lookback_hours(last_run: datetime | None, now: datetime) -> int | None:
    """How far a run looks back: the gap since the last one and an hour, a week at most; None on the first run."""
    if last_run is None:
        return None
    return int(min((now - last_run).total_seconds() / 3600, MAX_LOOKBACK_HOURS)) + 1


def asked_again(call: Callable[[], Page], tries: Mapping[int, int] = ByPost.tries, wait: Callable[[float], None] = time.sleep) -> Page:
    """``call``, again after a status as often as ``tries`` says, or after no answer, waiting twice as long each time."""
    delay, failed = FIRST_WAIT, {}
    while True:
        try:
            return call()
        except (Refused, TimeoutError, ConnectionError) as e:
            status = e.status if isinstance(e, Refused) else None
            failed[status] = failed.get(status, 0) + 1
            if failed[status] > (tries.get(status, 0) if status else SILENT_TRIES):
                raise
        wait(delay)
        delay *= 2


@dataclass
class Pace:
    """Calls spread evenly: ``per_minute`` over all partitions that run at once, with a margin."""

    per_minute: float
    clock: Callable[[], float] = time.monotonic
    wait: Callable[[float], None] = time.sleep
    next_at: float = field(default=0.0)

    def step(self) -> None:
        if self.per_minute > 0:
            now = self.clock()
            at = max(now, self.next_at)
            self.next_at = at + 60.0 / self.per_minute * PACE_MARGIN
            if at > now:
                self.wait(at - now)


def read_account(page: Callable[[str | None], Page], published: Callable[[dict], datetime | None], cutoff: datetime | None, most: int, pages: int, fallback_latest: bool = True) -> list[dict]:
    """Posts of one account, newest first, up to the first dated one before the cutoff.

    A page that fails after others came leaves what they brought.  With nothing new enough the newest post alone
    stands for the account.
    """
    kept: list[dict] = []
    newest, cursor = None, None
    for n in range(pages):
        try:
            got = page(cursor)
        except Exception:
            if n == 0:
                raise
            break
        for post in got.posts:
            newest = newest or post
            when = published(post)
            if cutoff is not None and when is not None and when < cutoff:
                return kept or ([newest] if fallback_latest else [])
            kept.append(post)
            if most and len(kept) >= most:
                return kept
        cursor = got.cursor
        if not got.posts or not cursor:
            break
    return kept or ([newest] if newest and fallback_latest else [])


def when_posted(post: dict) -> datetime | None:
    """The time of a post in any of the forms that backends send; None where there is none."""
    raw = post.get("createdAt")
    for layout in ("%a %b %d %H:%M:%S %z %Y", "%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%dT%H:%M:%S%z"):
        try:
            return datetime.strptime(raw, layout).astimezone(timezone.utc)
        except (ValueError, TypeError):
            continue
    return None


@dataclass
class Account(InputPartition):
    place: int
    handle: str
    after: int | None = None
    until: int | None = None


class _Calls:
    """Options that all readers share, and paced calls of a task; ``at_once`` tasks share the rate."""

    def __init__(self, options: Mapping[str, str], at_once: int):
        self.options = dict(options)
        self.per_minute = float(options.get("perminute", 0)) / max(1, at_once)

    def backend(self) -> Backend:
        return backend_of(self.options)

    def asker(self, backend: Backend):
        pace = Pace(self.per_minute)

        def ask(call: Callable):
            def once():
                pace.step()
                return call()

            return asked_again(once, backend.tries, time.sleep if self.per_minute else lambda s: None)

        return ask


class Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.handles = [h for h in options["handles"].split(",") if h]
        self.calls = _Calls(options, min(MOST_AT_ONCE, len(self.handles)))
        self.most, self.size = int(options.get("most", 0)), int(options.get("pagesize", Backend.page_size))
        self.cutoff = datetime.fromisoformat(options["cutoff"]) if options.get("cutoff") else None

    def partitions(self) -> list[Account]:
        return [Account(i, h) for i, h in enumerate(self.handles)]

    def read(self, account: Account) -> Iterator[tuple]:
        try:
            backend = self.calls.backend()
            ask = self.calls.asker(backend)
            posts = read_account(lambda c: ask(lambda: backend.page(account.handle, c)), when_posted, self.cutoff, self.most, page_limit(self.most, self.size))
        except Exception as e:
            yield account.place, account.handle, None, None, str(e) or type(e).__name__, isinstance(e, Refused) and e.status == 404
            return
        for i, post in enumerate(posts):
            yield account.place, account.handle, i, json.dumps(post, ensure_ascii=False), None, None


def _number(post: dict) -> int:
    return int(post["id"])


class Follower(DataSourceStreamReader):
    """New posts of accounts; the offset is the newest id seen of each.

    Accounts are asked for their newest post MOST_AT_ONCE at a time.  One that
    fails keeps its cursor and is asked again next time, one that isn't there
    yet has none; the others go on.  A task reads one account from its cursor
    to the newest id the offset names, so what is read again after a failure or
    restart is the same posts.
    """

    def __init__(self, options: Mapping[str, str]):
        self.handles = [h for h in options["handles"].split(",") if h]
        self.calls = _Calls(options, min(MOST_AT_ONCE, len(self.handles)))
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def _newest(self, handle: str) -> int | None:
        try:
            backend = self.calls.backend()
            posts = self.calls.asker(backend)(lambda: backend.page(handle, None)).posts
            return max(map(_number, posts), default=None)
        except Exception:
            return None

    def latestOffset(self) -> dict:
        with ThreadPoolExecutor(MOST_AT_ONCE) as pool:
            for handle, newest in zip(self.handles, pool.map(self._newest, self.handles)):
                if newest is not None:
                    self.known[handle] = max(newest, self.known.get(handle, newest))
        return {h: str(n) for h, n in sorted(self.known.items())}

    def partitions(self, start: dict, end: dict) -> list[Account]:
        """Accounts with new posts.  After a restart an account that can't be asked is missing in ``end``: its cursor is not lost, as ``start`` has it."""
        for handle, newest in start.items():
            self.known[handle] = max(int(newest), self.known.get(handle, 0))
        return [Account(i, h, int(start[h]) if h in start else None, int(end[h])) for i, h in enumerate(self.handles) if h in end and int(end[h]) > int(start.get(h, -1))]

    def read(self, account: Account) -> Iterator[tuple]:
        backend = self.calls.backend()
        ask = self.calls.asker(backend)
        cursor, found = None, []
        while True:
            page = ask(lambda: backend.page(account.handle, cursor))
            found += [p for p in page.posts if (account.after is None or _number(p) > account.after) and _number(p) <= account.until]
            if not page.posts or not page.cursor or (account.after is not None and min(map(_number, page.posts)) <= account.after):
                break
            cursor = page.cursor
        for i, post in enumerate(found):
            yield account.place, account.handle, i, json.dumps(post, ensure_ascii=False), None, None


class Timelines(DataSource):
    """Options: backend (by-post, by-call, module:Class) and what it takes (path), handles (comma-separated, in order), most, pageSize, cutoff (ISO), perMinute."""

    @classmethod
    def name(cls) -> str:
        return "timelines"

    def schema(self) -> str:
        return "place int, handle string, pos int, post string, failed string, not_found boolean"

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> Follower:
        return Follower(self.options)


@dataclass
class Ids(InputPartition):
    ids: list[str]


class Lookup(DataSourceReader):
    """Posts by id: a filter on ``id`` is what is asked for, in batches of what the backend takes at once."""

    def __init__(self, options: Mapping[str, str]):
        self.calls = _Calls(options, MOST_AT_ONCE)
        self.ids: list[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            wanted = [f.value] if isinstance(f, EqualTo) and f.attribute == ("id",) else list(f.value) if isinstance(f, In) and f.attribute == ("id",) else None
            if wanted is None:
                yield f
            else:
                own = list(dict.fromkeys(v for v in wanted if v is not None))
                self.ids = own if self.ids is None else [i for i in self.ids if i in set(own)]

    def partitions(self) -> list[Ids]:
        if self.ids is None:
            raise ValueError("posts are looked up by id: filter on id, with spark.sql.python.filterPushdown.enabled")
        size = self.calls.backend().most_ids
        return [Ids(self.ids[i : i + size]) for i in range(0, len(self.ids), size)]

    def read(self, part: Ids) -> Iterator[tuple]:
        backend = self.calls.backend()
        try:
            for post in self.calls.asker(backend)(lambda: backend.posts(part.ids)):
                yield str(post["id"]), json.dumps(post, ensure_ascii=False), None
        except (Refused, OSError) as e:
            for i in part.ids:
                yield i, None, str(e) or type(e).__name__


class Posts(DataSource):
    """Options: backend and what it takes, perMinute."""

    @classmethod
    def name(cls) -> str:
        return "posts"

    def schema(self) -> str:
        return "id string, post string, failed string"

    def reader(self, schema) -> Lookup:
        return Lookup(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Timelines, Posts):
        spark.dataSource.register(source)
