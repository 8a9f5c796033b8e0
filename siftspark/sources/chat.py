"""Asking chat models over HTTP, one row per request.

A provider is data: where its chat lives, what a request looks like and where in the reply the text is. ``HttpChat`` joins one
with a server and a model; whatever else has ``complete(system, user) -> str`` and can be pickled will do as well. Requests
carry a key, so a task that runs again asks again for the same key and overwrites nothing.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame

ANSWERS = "key string, raw string, attempts int, error string"
# Names of the local machine, and how the two kinds of server want to be asked.
LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1")
PROVIDERS: dict[str, dict[str, Any]] = {
    "ollama": {"path": "/api/chat", "fixed": {"stream": False, "format": "json", "options": {"temperature": 0}}, "reply": ("message", "content"), "local": True},
    "openai": {"path": "/chat/completions", "fixed": {"temperature": 0}, "reply": ("choices", 0, "message", "content"), "local": False},
}


def require_local(url: str) -> None:
    """A verifier must not send evidence elsewhere."""
    if (urlsplit(url).hostname or "") not in LOCAL_HOSTS:
        raise ValueError(f"{url} is not this machine")


@dataclass(frozen=True)
class HttpChat:
    """One model of one server. ``headers`` carries what the server wants besides the content type, such as a bearer token."""

    provider: str
    server: str
    model: str
    headers: Mapping[str, str] = field(default_factory=dict)
    seconds: float = 120.0

    def __post_init__(self):
        if self.provider not in PROVIDERS:
            raise ValueError(f"unknown provider {self.provider}; there are {sorted(PROVIDERS)}")
        if PROVIDERS[self.provider]["local"]:
            require_local(self.server)

    def request(self, system: str, user: str) -> urllib.request.Request:
        told = [{"role": r, "content": c} for r, c in (("system", system), ("user", user))]
        body = {"model": self.model, "messages": told} | PROVIDERS[self.provider]["fixed"]
        return urllib.request.Request(self.server.rstrip("/") + PROVIDERS[self.provider]["path"], json.dumps(body).encode(), {"Content-Type": "application/json", **self.headers})

    def read(self, reply: bytes) -> str:
        at: Any = json.loads(reply)
        for step in PROVIDERS[self.provider]["reply"]:
            at = at[step]
        if not isinstance(at, str):
            raise ValueError("the reply holds no text")
        return at

    def complete(self, system: str, user: str) -> str:
        with urllib.request.urlopen(self.request(system, user), timeout=self.seconds) as reply:
            return self.read(reply.read())


def _answer(backend: Any, system: str, user: str, tries: int) -> tuple[str | None, int, str | None]:
    """(text, tries used, error): the last error stands where no try gave a text."""
    said = None
    for used in range(1, tries + 1):
        try:
            return backend.complete(system, user), used, None
        except Exception as e:
            said = f"{type(e).__name__}: {e}"
    return None, tries, said


def complete(requests: DataFrame, backend: Any, retries: int = 1) -> DataFrame:
    """requests (key, system, user) to (key, raw, attempts, error); an error after the last try is a row."""
    if retries not in (0, 1, 2):
        raise ValueError("retries is 0, 1 or 2")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            told = [(k, *_answer(backend, s, u, retries + 1)) for k, s, u in zip(pdf["key"], pdf["system"], pdf["user"], strict=True)]
            yield pd.DataFrame(told, columns=["key", "raw", "attempts", "error"])

    return requests.select("key", "system", "user").mapInPandas(run, ANSWERS)
