"""Backends of timelines: where pages and posts come from, how large they are, which refusals are tried again.

A reader finds its backend by name: one of ``BACKENDS``, or ``package.module:Class`` for one of the user's own.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from importlib import import_module


class Refused(Exception):
    """An answer with a status that isn't success."""

    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


@dataclass
class Page:
    posts: list[dict]
    cursor: str | None = None


class Backend:
    """What a reader asks; made anew in each task from the reader's options."""

    #: Posts a page, ids a look-up, and how often each status is tried again (fixed values of the services).
    page_size, most_ids = 20, 200
    tries: Mapping[int, int] = {}

    def __init__(self, options: Mapping[str, str]):
        self.options = options

    def page(self, handle: str, cursor: str | None) -> Page:
        """A page of an account's posts, newest first; ``Refused(404)`` where there is no such account."""
        raise NotImplementedError

    def posts(self, ids: list[str]) -> list[dict]:
        """The posts of some ids, those that there are."""
        raise NotImplementedError


class Recorded(Backend):
    """Recorded answers under ``path``, of any file system that pyarrow knows: pages as ``name/0.json``, ``1.json``, ..., posts as ``posts/id.json``."""

    def answer(self, *names: str) -> dict | None:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.options["path"]) if "://" in self.options["path"] else (fs.LocalFileSystem(), self.options["path"])
        try:
            with system.open_input_stream("/".join([root.rstrip("/"), *names])) as f:
                found = json.loads(f.read())
        except FileNotFoundError:
            return None
        if isinstance(found, dict) and "status" in found:
            raise Refused(found["status"])
        return found

    def name_of(self, handle: str) -> str:
        return handle

    def page(self, handle: str, cursor: str | None) -> Page:
        n = int(cursor or 0)
        found = self.answer(self.name_of(handle), f"{n}.json")
        if found is None and n == 0:
            raise Refused(404)
        return Page(found["posts"] if found else [], str(n + 1))

    def posts(self, ids: list[str]) -> list[dict]:
        return [p for p in (self.answer("posts", f"{i}.json") for i in ids) if p is not None]


class ByPost(Recorded):
    """The service that bills by post: only its rate limit passes with time."""

    tries = {429: 4}


class ByCall(Recorded):
    """The service that bills by call: pages go by a user's id, which ``users.json`` gives for a handle; its gateway fails now and then."""

    tries = {429: 4} | dict.fromkeys((502, 503, 504, 520, 521, 522, 523, 524), 2)

    def name_of(self, handle: str) -> str:
        if not hasattr(self, "users"):
            self.users = {k.lower(): v for k, v in (self.answer("users.json") or {}).items()}
        if handle.lower() not in self.users:
            raise Refused(404)
        return str(self.users[handle.lower()])


BACKENDS: dict[str, type[Backend]] = {"by-post": ByPost, "by-call": ByCall}


def backend_of(options: Mapping[str, str]) -> Backend:
    name = options.get("backend") or "by-post"
    if name in BACKENDS:
        return BACKENDS[name](options)
    module, colon, kind = name.partition(":")
    if not colon:
        raise ValueError(f"no backend {name!r}: name one of {', '.join(BACKENDS)}, or module:Class")
    return getattr(import_module(module), kind)(options)
