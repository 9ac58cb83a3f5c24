"""Streamed chat replies: the text, and how fast it came."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


@dataclass
class Reply:
    text: str = ""
    completion_tokens: int | None = None
    first_token_s: float | None = None
    seconds: float = 0.0

    @property
    def tokens_per_s(self) -> float:
        spent = self.seconds - (self.first_token_s or 0.0)
        return self.completion_tokens / spent if self.completion_tokens and spent > 0 else 0.0


def parse_stream(lines: Iterable[bytes], clock: Callable[[], float] = time.monotonic) -> Reply:
    """Server-sent events up to ``[DONE]``: pieces of text and the usage record; a stream that ends before is an error."""
    began, out, done = clock(), Reply(), False
    for line in lines:
        line = line.strip()
        if not line.startswith(b"data:"):
            continue
        data = line[5:].strip()
        if data == b"[DONE]":
            done = True
            break
        event = json.loads(data)
        if "error" in event:
            raise RuntimeError(str(event["error"]))
        for choice in event.get("choices") or []:
            piece = (choice.get("delta") or {}).get("content") or ""
            if piece and out.first_token_s is None:
                out.first_token_s = clock() - began
            out.text += piece
        if event.get("usage"):
            out.completion_tokens = event["usage"].get("completion_tokens")
    if not done:
        raise EOFError("the stream ended before it was done")
    out.seconds = clock() - began
    return out


def summarize(docs: DataFrame, endpoint: str, model: str, prompt: str, id_col: str = "path", text_col: str = "text", timeout: float = 300.0) -> DataFrame:
    """``(id, summary, completion_tokens, tokens_per_s, error)`` of each document, asked for on the workers."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["i"], b["t"]):
                body = {"model": model, "stream": True, "stream_options": {"include_usage": True}, "messages": [{"role": "system", "content": prompt}, {"role": "user", "content": t or ""}]}
                request = urllib.request.Request(f"{endpoint.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json"})
                try:
                    with urllib.request.urlopen(request, timeout=timeout) as r:
                        reply = parse_stream(r)
                    rows.append((i, reply.text, reply.completion_tokens, reply.tokens_per_s, None))
                except Exception as e:
                    rows.append((i, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[id_col, "summary", "completion_tokens", "tokens_per_s", "error"])

    own = docs.selectExpr(f"`{id_col}` AS i", f"`{text_col}` AS t")
    return own.mapInPandas(run, f"`{id_col}` {kind}, summary string, completion_tokens long, tokens_per_s double, error string")
