"""Injected providers: language model, embeddings, search, storage, media. Each is a small protocol with an offline stand-in."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GatewayError(RuntimeError):
    """The model gave no usable answer in all its tries."""


class Gateway(Protocol):
    def complete(self, system: str, user: str) -> dict[str, Any]: ...


class StubGateway:
    """Answers by rules (a part of the prompt, the answer); the last answer is for all other prompts. It runs on executors too."""

    def __init__(self, rules: list[tuple[str, dict[str, Any]]], otherwise: dict[str, Any] | None = None):
        self.rules, self.otherwise = rules, otherwise

    def complete(self, system: str, user: str) -> dict[str, Any]:
        for part, answer in self.rules:
            if part.lower() in user.lower():
                return answer
        if self.otherwise is None:
            raise GatewayError("no answer")
        return self.otherwise


class Retrying:
    """A gateway that tries again after growing pauses."""

    def __init__(self, inner: Gateway, tries: int = 3, pause: float = 0.5):
        self.inner, self.tries, self.pause = inner, tries, pause

    def complete(self, system: str, user: str) -> dict[str, Any]:
        for k in range(self.tries):
            try:
                return self.inner.complete(system, user)
            except Exception as error:
                if k + 1 == self.tries:
                    raise GatewayError(str(error)) from error
                time.sleep(self.pause * 2**k)
        raise GatewayError("no tries")


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic unit vector of a text, the stand-in for an embedding model: signed counts of its words by hash."""

    @F.pandas_udf("array<float>")
    def embed(s: pd.Series) -> pd.Series:
        def one(t):
            v = [0.0] * dim
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            n = sum(x * x for x in v) ** 0.5
            return [x / n for x in v] if n else None

        return s.map(one)

    return embed(text)


class SearchProvider(Protocol):
    def search(self, query: str, limit: int) -> list[dict[str, Any]]: ...


def web_search(spark, provider: SearchProvider, queries: list[str], limit: int = 5) -> DataFrame:
    """(query, url, title, content, score) of a provider's results: 1 to 20 a query, none without a url, a score that is no number 0."""
    limit = max(1, min(20, limit))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def number(x):
            try:
                return float(x)
            except (TypeError, ValueError):
                return 0.0

        for f in frames:
            rows = [(q, r["url"], r.get("title") or "", r.get("content") or "", number(r.get("score"))) for q in f["query"] for r in provider.search(q, limit)[:limit] if r.get("url")]
            yield pd.DataFrame(rows, columns=["query", "url", "title", "content", "score"])

    return spark.createDataFrame([(q,) for q in queries], "query string").mapInPandas(run, "query string, url string, title string, content string, score double")


def described(files: DataFrame, provider: Callable[[bytes], dict[str, str]], kind: str) -> DataFrame:
    """(path, text) of images (caption and OCR text) or sound (a transcript) by an injected provider; files over the size limit are refused with an error."""
    limit = {"image": 20, "audio": 25}[kind] * 1024 * 1024

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                if len(content) > limit:
                    rows.append((path, None, f"{kind} over {limit} bytes"))
                    continue
                got = provider(bytes(content))
                text = got.get("transcript", "") if kind == "audio" else "\n\n".join(x for x in (got.get("caption", ""), f"OCR: {got['ocr']}" if got.get("ocr") else "") if x)
                rows.append((path, text, None))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")
