"""Which failures of a remote service pass, and how long to wait for that."""

from __future__ import annotations

import http.client
import itertools
import logging
import random
import socket
import time
import urllib.error
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

T = TypeVar("T")
log = logging.getLogger("corvane.sources")

# Requests in all, seconds of the first pause, and of the longest.
TRIES, FIRST_PAUSE, LONGEST_PAUSE = 3, 0.5, 8.0


class HttpError(Exception):
    """A response that is not a success."""

    def __init__(self, status: int, url: str = "") -> None:
        super().__init__(f"HTTP {status} {url}")
        self.status = status


class UnknownSpace(Exception):
    """The source has no space of this key; the whole scan ends."""


def worth_retrying(error: BaseException) -> bool:
    """Whether asking again may help: the connection broke, timed out or found no name, or the service was busy or failed.

    Other responses, certificates that don't hold, missing files and errors of our own stay as they are.
    """
    if isinstance(error, HttpError):
        return error.status == 429 or error.status // 100 == 5
    if isinstance(error, urllib.error.URLError) and isinstance(error.reason, BaseException):
        return worth_retrying(error.reason)
    return isinstance(error, (ConnectionError, TimeoutError, socket.gaierror, http.client.HTTPException))


def pauses(first: float = FIRST_PAUSE, longest: float = LONGEST_PAUSE) -> Iterator[float]:
    """Seconds before each repetition, without end: doubling from ``first`` to ``longest``, and up to ``first`` more by chance."""
    doubling = itertools.accumulate(itertools.repeat(2.0), lambda s, f: min(longest, s * f), initial=min(first, longest))
    return (s + random.uniform(0.0, first) for s in doubling)


def with_retries(ask: Callable[[], T], *, waits: Iterable[float] | None = None, sleep: Callable[[float], None] = time.sleep) -> T:
    """What ``ask`` gives, asked again after each of ``waits`` while it fails in a way that may pass. The last failure is raised."""
    left = iter(itertools.islice(pauses(), TRIES - 1) if waits is None else waits)
    while True:
        try:
            return ask()
        except Exception as error:
            wait = next(left, None) if worth_retrying(error) else None
            if wait is None:
                raise
            log.warning("%s: asking again in %.1f s", error, wait)
        sleep(wait)
