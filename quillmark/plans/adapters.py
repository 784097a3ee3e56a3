"""Calling remote models politely.  No provider is built in; a call is any function."""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable

#: Fixed values.
RETRY_STATUS = frozenset({429, 500, 502, 503, 504})
TRIES, LONGEST_WAIT = 6, 120.0
_WAITS = (re.compile(r"'retryDelay':\s*'(\d+(?:\.\d+)?)s'"), re.compile(r"retry in (\d+(?:\.\d+)?)\s*s", re.IGNORECASE), re.compile(r"try again in (?:(\d+)m)?(\d+(?:\.\d+)?)s", re.IGNORECASE))


class RemoteError(Exception):
    """A failed call: its HTTP status (none for transport faults), message and Retry-After."""

    def __init__(self, message: str, status: int | None = None, retry_after: str | None = None) -> None:
        super().__init__(message)
        self.status, self.retry_after = status, retry_after


def retryable(error: RemoteError) -> bool:
    return error.status is None or error.status in RETRY_STATUS


def server_wait(error: RemoteError) -> float | None:
    """Seconds that the server asks to wait, from the header or the message."""
    try:
        if error.retry_after is not None:
            return float(error.retry_after)
    except ValueError:
        pass  # a date; the message may say more
    for pattern in _WAITS:
        if m := pattern.search(str(error)):
            return sum(float(x) * f for x, f in zip(m.groups()[::-1], (1, 60), strict=False) if x)
    return None


def with_backoff(call: Callable[[], str], sleep: Callable[[float], None] = time.sleep) -> str:
    for attempt in range(TRIES):
        try:
            return call()
        except RemoteError as error:
            if attempt + 1 == TRIES or not retryable(error):
                raise
            asked = server_wait(error)
            sleep(min(LONGEST_WAIT, 2.0**attempt if asked is None else asked) + random.random())
    raise AssertionError("unreachable")


class RateLimiter:
    """At most ``per_minute`` calls over all of ``partitions`` tasks that run at once."""

    def __init__(self, per_minute: float, partitions: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.gap, self.clock, self.sleep, self.next = 60.0 * partitions / per_minute, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap
