"""Remote services called from tasks: retries, fallback, and one result row per input row.

A client is made once per partition by a factory, so nothing but the factory travels. Calls may be repeated when a task
is, so clients must be idempotent; an error becomes a value of the row, never a failed task.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.functions import text as tx


class ChatProvider(Protocol):
    """What a text-generating service offers."""

    name: str

    def chat_completion(self, messages: list[dict], model: str, temperature: float, max_tokens: int = 1500) -> str: ...


class Retryable(Exception):
    """A failure that may pass: a rate limit or a server error."""


def retried(call: Callable[[], str], attempts: int = 3, first_wait: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """The call's result; waits double between attempts, other errors pass at once."""
    for n in range(attempts):
        try:
            return call()
        except Retryable:
            if n == attempts - 1:
                raise
            sleep(first_wait * 2**n)
    raise AssertionError


class Fallback:
    """A provider that turns to a second one when the first fails in a way that may pass."""

    def __init__(self, primary: ChatProvider, second: ChatProvider):
        self.primary, self.second = primary, second
        self.name = f"{primary.name}+{second.name}"

    def chat_completion(self, messages, model, temperature, max_tokens=1500):
        try:
            return self.primary.chat_completion(messages, model, temperature, max_tokens)
        except Retryable:
            return self.second.chat_completion(messages, model, temperature, max_tokens)


def _passes(text: str) -> tuple[bool, str]:
    """The rule check in plain Python, for use inside a task: (passes, what to fix)."""
    import re

    body = text.strip()
    one = len(re.findall(r"[.!?]\s+", body)) == 0
    n = len(body.split())
    method, outcome = re.search(tx.METHOD_HINTS, body), re.search(tx.OUTCOME_HINTS, body)
    issues = [("one sentence", one), (f"{tx.FEWEST_WORDS} to {tx.MOST_WORDS} words", tx.FEWEST_WORDS <= n <= tx.MOST_WORDS), ("a method phrase", method), ("an outcome phrase", outcome)]
    missing = [what for what, ok in issues if not ok]
    return not missing, "The statement must have " + ", ".join(missing) + "." if missing else ""


def _asking(client: ChatProvider, model: str, temperature: float, first_wait: float, most: int = 1500) -> Callable[[list[dict]], str]:
    """Calls of the service that are repeated while they fail in a way that may pass."""
    return lambda messages: retried(lambda: client.chat_completion(messages, model, temperature, most), first_wait=first_wait).strip()


def generate(rows: DataFrame, key: str, prompt: str, factory: Callable[[], ChatProvider], *, model: str = "", temperature: float = 0.2, max_fixes: int = 1, first_wait: float = 10.0) -> DataFrame:
    """(key, statement, rewrites, error): one generated statement per prompt, rewritten up to `max_fixes` times while it fails the rules."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = _asking(factory(), model, temperature, first_wait)
        for pdf in batches:
            out = []
            for k, p in zip(pdf["k"], pdf["p"], strict=True):
                try:
                    text, rewrites = ask([{"role": "user", "content": p}]), 0
                    ok, issue = _passes(text)
                    while not ok and rewrites < max_fixes:
                        talk = [{"role": "user", "content": p}, {"role": "assistant", "content": text}, {"role": "user", "content": issue}]
                        text, rewrites = ask(talk), rewrites + 1
                        ok, issue = _passes(text)
                    out.append((k, text, rewrites, None))
                except Exception as error:  # noqa: BLE001 - kept with the row
                    out.append((k, f"ERROR: {error}", 0, str(error)))
            yield pd.DataFrame(out, columns=["k", "statement", "rewrites", "error"])

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("k"), F.col(prompt).alias("p")).mapInPandas(work, f"k {kind}, statement string, rewrites int, error string").withColumnRenamed("k", key)


def keywords(rows: DataFrame, key: str, statement: str, criteria: str, factory: Callable[[], ChatProvider], *, model: str = "", temperature: float = 0.1, first_wait: float = 10.0) -> DataFrame:
    """(key, keywords, error): one call per statement; a call that fails gives no keywords and its error."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = _asking(factory(), model, temperature, first_wait, 200)
        for pdf in batches:
            out = []
            for k, s, c in zip(pdf["k"], pdf["s"], pdf["c"], strict=True):
                try:
                    out.append((k, ask([{"role": "user", "content": f"Skill statement:\n{s}\n\nPerformance criteria:\n{c}"}]), None))
                except Exception as error:  # noqa: BLE001 - kept with the row
                    out.append((k, None, str(error)))
            yield pd.DataFrame(out, columns=["k", "keywords", "error"])

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("k"), F.col(statement).alias("s"), F.col(criteria).alias("c")).mapInPandas(work, f"k {kind}, keywords string, error string").withColumnRenamed("k", key)


def embed(rows: DataFrame, key: str, text: str, factory: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 100) -> DataFrame:
    """(key, embedding): texts sent in batches; blank texts as 'empty'."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = factory()
        for pdf in batches:
            texts = [t if t and t.strip() else "empty" for t in pdf["t"]]
            vectors = [v for lo in range(0, len(texts), batch) for v in call(texts[lo : lo + batch])]
            yield pd.DataFrame({"k": pdf["k"], "embedding": vectors})

    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(work, f"k {kind}, embedding array<float>").withColumnRenamed("k", key)


def hashing_embedder(size: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """An embedder without a service: signed hashed words, unit length."""
    import re
    import zlib

    def call(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * size
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                v[h % size] += 1.0 if h >> 31 else -1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out

    return call


class SkillService(Protocol):
    """What a skills-and-occupations service offers."""

    def skills(self, text: str, limit: int) -> list[dict]: ...
    def occupations(self, uri: str, relation: str, limit: int) -> list[dict]: ...


def match_skills(rows: DataFrame, key: str, statement: str, factory: Callable[[], SkillService], *, top_skills: int = 3, top_occupations: int = 5, min_score: float = 0.0) -> DataFrame:
    """(key, skill_uris, skill_titles, scores, occupation_uris, occupation_titles): matches of each statement.

    Essential occupations come before optional ones; of repeated URIs the first counts. Texts are sent by their first 500
    characters, as the service takes no more.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for pdf in batches:
            out = []
            for k, s in zip(pdf["k"], pdf["s"], strict=True):
                found = [x for x in (client.skills(s[:500], top_skills) if s else []) if x.get("score", 0) >= min_score]
                seen: dict[str, str] = {}
                for relation in ("isEssentialForOccupation", "isOptionalForOccupation"):
                    for x in client.occupations(found[0]["uri"], relation, top_occupations) if found else []:
                        seen.setdefault(x["uri"], x["title"])
                kept = list(seen.items())[:top_occupations]
                out.append((k, [x["uri"] for x in found], [x["title"] for x in found], [float(x.get("score", 0)) for x in found], [u for u, _ in kept], [t for _, t in kept]))
            yield pd.DataFrame(out, columns=["k", "skill_uris", "skill_titles", "scores", "occupation_uris", "occupation_titles"])

    kind = dict(rows.dtypes)[key]
    schema = f"k {kind}, skill_uris array<string>, skill_titles array<string>, scores array<double>, occupation_uris array<string>, occupation_titles array<string>"
    return rows.select(F.col(key).alias("k"), F.col(statement).alias("s")).mapInPandas(work, schema).withColumnRenamed("k", key)


def fetch(codes: DataFrame, key: str, factory: Callable[[], Callable[[str], str | None]]) -> DataFrame:
    """(key, payload, error): one request per distinct code; a failure is a null payload."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = factory()
        for pdf in batches:
            out = []
            for k in pdf["k"]:
                try:
                    out.append((k, call(k), None))
                except Exception as error:  # noqa: BLE001 - kept with the row
                    out.append((k, None, str(error)))
            yield pd.DataFrame(out, columns=["k", "payload", "error"])

    kind = dict(codes.dtypes)[key]
    return codes.select(F.col(key).alias("k")).where("k is not null").distinct().mapInPandas(work, f"k {kind}, payload string, error string").withColumnRenamed("k", key)
