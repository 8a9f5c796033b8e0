"""Fetching pages politely. The opener is given, so nothing here needs a network to be tested.

One limiter must see all requests, so the source has one partition; what is fetched is stored once and read from there.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame

#: When to try again, how long to wait, what to accept.
RETRY_STATUS = frozenset((408, 429, 500, 502, 503, 504))
TYPES = ("text/html", "application/xhtml+xml")
MAX_BYTES, ATTEMPTS, BASE_WAIT, GAP = 10 * 1024 * 1024, 4, 1.0, 1.0
RESULT = "document_id string, url string, status string, http_status int, attempts int, final_url string, html string, error string"


@dataclass
class Answer:
    status: int
    url: str
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes = b""


class FetchError(Exception):
    pass


@dataclass
class RateLimiter:
    gap: float = GAP
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    last: float | None = None

    def wait(self) -> None:
        if self.last is not None and (left := self.last + self.gap - self.clock()) > 0:
            self.sleep(left)
        self.last = self.clock()


def retry_after(value: str | None, now: float) -> float:
    """Seconds from a Retry-After header, a number or a date; never negative."""
    if not value:
        return 0.0
    try:
        return max(0.0, float(value))
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(value).timestamp() - now)
    except (TypeError, ValueError):
        return 0.0


def check_answer(answer: Answer, hosts: frozenset[str]) -> None:
    """Redirects stay on https and allowed hosts; the type and size fit."""
    parts = urlsplit(answer.url)
    if parts.scheme != "https" or (parts.hostname or "").lower() not in hosts:
        raise FetchError(f"led to {answer.url}")
    kind = answer.headers.get("content-type", "").split(";")[0].strip().lower()
    if kind not in TYPES:
        raise FetchError(f"content type {kind or 'missing'}")
    if not answer.body or len(answer.body) > MAX_BYTES:
        raise FetchError(f"{len(answer.body)} bytes")


def fetch(url: str, opener: Callable[[str], Answer], limiter: RateLimiter, hosts: frozenset[str], now: Callable[[], float] = time.time) -> tuple[Answer, int]:
    """The answer and the number of tries; waits the longer of Retry-After and a doubling pause between tries."""
    for attempt in range(1, ATTEMPTS + 1):
        limiter.wait()
        answer = opener(url)
        if answer.status == 200:
            check_answer(answer, hosts)
            return answer, attempt
        if answer.status not in RETRY_STATUS or attempt == ATTEMPTS:
            raise FetchError(f"status {answer.status}")
        limiter.sleep(max(retry_after(answer.headers.get("retry-after"), now()), BASE_WAIT * 2 ** (attempt - 1)))
    raise FetchError("no tries left")


def fetch_table(manifest: DataFrame, opener: Callable[[str], Answer], hosts: frozenset[str], gap: float = GAP) -> DataFrame:
    """One row per manifest row (id, url), failures as rows with their error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limiter = RateLimiter(gap)
        for pdf in batches:
            rows = []
            for i, u in zip(pdf["id"], pdf["url"], strict=True):
                try:
                    a, n = fetch(u, opener, limiter, hosts)
                    rows.append((i, u, "success", a.status, n, a.url, a.body.decode("utf-8", "replace"), None))
                except Exception as e:  # a page that fails is a result, not the end of the run
                    rows.append((i, u, "failed", None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return manifest.select("id", "url").coalesce(1).mapInPandas(run, RESULT)
