"""Embedding specifications, prompt composition and embedders."""

from __future__ import annotations

import hashlib
import json
import math
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATE_RESERVE, LEAST_CEILING, BYTES_PER_TOKEN, BATCH = 256, 80, 4, 64

# Defaults by a part of the model's name.
REGISTRY = {"embeddinggemma": ("task: search result | query: {q}", "title: {t} | text: {d}", 2048)}


@dataclass(frozen=True)
class EmbeddingSpec:
    model: str
    query_template: str = ""
    passage_template: str = ""
    ceiling_tokens: int = 0

    def validate(self) -> None:
        if self.query_template and "{q}" not in self.query_template:
            raise ValueError("query template lacks {q}")
        if self.passage_template and "{d}" not in self.passage_template:
            raise ValueError("passage template lacks {d}")
        if len(self.passage_template.encode()) > TEMPLATE_RESERVE:
            raise ValueError(f"passage template exceeds {TEMPLATE_RESERVE} bytes")
        if self.ceiling_tokens and self.ceiling_tokens < LEAST_CEILING:
            raise ValueError(f"ceiling must be 0 or at least {LEAST_CEILING} tokens")

    def fingerprint(self) -> str:
        """What makes vectors stale when it changes; the ceiling counts."""
        q = lambda s: json.dumps(s, ensure_ascii=False)
        return f"model={q(self.model)} q={q(self.query_template)} d={q(self.passage_template)} ceil={self.ceiling_tokens}"

    def compatible(self, other: EmbeddingSpec) -> str | None:
        """None if queries of one may meet vectors of the other, else what differs; the ceiling does not count."""
        if self.model != other.model:
            return "model"
        same = (self.query_template, self.passage_template) == (other.query_template, other.passage_template)
        return None if same else "template"


def resolve_spec(model: str, query: str = "", passage: str = "", ceiling: int = 0) -> EmbeddingSpec:
    """Given values, else those registered for the longest (then first) key within the model's name, else none."""
    keys = [k for k in REGISTRY if k in model.lower()]
    q, d, c = REGISTRY[min(keys, key=lambda k: (-len(k), k))] if keys else ("", "", 0)
    return EmbeddingSpec(model, query or q, passage or d, ceiling or c)


def compose_query(query: Column, template: str) -> Column:
    """The query as embedded: the template with every ``{q}`` filled, or the query itself."""
    return _fill(template, {"{q}": query}) if template else query


def _fill(template: str, values: dict[str, Column]) -> Column:
    """One pass over the template: placeholders inside the values are left alone."""
    parts: list[Column] = []
    rest = template
    while rest:
        at, key = min(((i, k) for k in values if (i := rest.find(k)) >= 0), default=(len(rest), ""))
        if at:
            parts.append(F.lit(rest[:at]))
        if key:
            parts.append(values[key])
        rest = rest[at + len(key) :]
    return F.concat(*parts) if parts else F.lit("")


def compose_passage(text: Column, heading_path: Column, template: str) -> Column:
    """The passage as embedded: heading path at {t} (``none`` without one), or before the text where the template has no {t}."""
    path = F.coalesce(heading_path, F.lit(""))
    if "{t}" in template:
        return _fill(template, {"{t}": F.when(path == "", F.lit("none")).otherwise(path), "{d}": text})
    body = F.when(path == "", text).otherwise(F.concat(path, F.lit("\n\n"), text))
    return _fill(template, {"{d}": body}) if template else body


def too_long(composed: Column, ceiling_tokens: int) -> Column:
    return F.lit(False) if ceiling_tokens <= 0 else F.octet_length(composed) > ceiling_tokens * BYTES_PER_TOKEN


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class HashEmbedder:
    """Deterministic vectors without a model: signed hashed words, for tests and offline runs."""

    dims: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dims
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.dims] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


class EmbeddingError(RuntimeError):
    def __init__(self, message: str, transient: bool):
        super().__init__(message)
        self.transient = transient


def transient(error: BaseException) -> bool:
    """Worth another try: deadlines, broken connections, 408, 429 and server errors; not cancellation."""
    if isinstance(error, EmbeddingError):
        return error.transient
    if isinstance(error, urllib.error.HTTPError):
        return error.code in (408, 429) or error.code >= 500
    return isinstance(error, (TimeoutError, EOFError, ConnectionError, urllib.error.URLError)) and not isinstance(error, KeyboardInterrupt)


@dataclass(frozen=True)
class HttpEmbedder:
    """``POST {endpoint}/embeddings`` in batches; results are placed by their ``index``."""

    endpoint: str
    model: str
    timeout: float = 60.0

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), BATCH):
            part = texts[at : at + BATCH]
            body = json.dumps({"model": self.model, "input": part}).encode()
            request = urllib.request.Request(f"{self.endpoint.rstrip('/')}/embeddings", body, {"Content-Type": "application/json"})
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    data = json.load(r)["data"]
            except Exception as e:
                raise EmbeddingError(str(e), transient(e)) from e
            placed: list[list[float] | None] = [None] * len(part)
            for d in data:
                if not 0 <= d["index"] < len(part) or placed[d["index"]] is not None:
                    raise EmbeddingError("bad index in reply", False)
                placed[d["index"]] = d["embedding"]
            if any(p is None for p in placed) or len({len(p) for p in placed if p is not None}) > 1:
                raise EmbeddingError("incomplete or uneven reply", False)
            out += placed  # type: ignore[arg-type]
        return out


def embed_passages(df: DataFrame, embedder: Embedder, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``embedding``; a narrow map, batch by batch."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[keep].assign(embedding=embedder.embed(list(b["_x"])))

    return df.select(*keep, F.col(text_col).alias("_x")).mapInPandas(run, f"{fields}, embedding array<float>")
