"""Encodings, previews and control characters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space and controls as the index format defines them.
SPACES = frozenset("\t\n\v\f\r \x85\xa0                　")
BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", None), (b"\x00\x00\xfe\xff", None), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def _control(c: str) -> bool:
    return c < " " or "\x7f" <= c <= "\x9f"


def normalize(raw: bytes | None) -> tuple[str | None, str | None]:
    """``(text, error)``: UTF-8 or BOM-marked UTF-16 without the BOM; UTF-32 and malformed input are errors."""
    if raw is None:
        return None, "no bytes"
    for bom, codec in BOMS:
        if raw.startswith(bom):
            if codec is None:
                return None, "UTF-32 is not supported"
            body = raw[len(bom) :]
            if codec != "utf-8" and len(body) % 2:
                return None, "odd number of bytes in UTF-16"
            break
    else:
        codec, body = "utf-8", raw
    try:
        return body.decode(codec), None
    except UnicodeDecodeError as e:
        return None, f"invalid {codec}: {e.reason}"


def normalize_bytes(df: DataFrame, raw: str = "raw", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all other columns by default) with ``text`` and ``error`` in place of the bytes."""
    keep = [c for c in df.columns if c != raw] if keep is None else keep
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [normalize(None if x is None else bytes(x)) for x in b[raw]]
            yield b[keep].assign(text=[t for t, _ in done], error=[e for _, e in done])

    return df.select(*keep, raw).mapInPandas(run, f"{fields}{', ' if fields else ''}text string, error string")


def preview_of(text: str | None, most: int) -> str | None:
    """White space runs as one blank, no controls, at most ``most`` characters, then an ellipsis if more follow."""
    if text is None:
        return None
    out: list[str] = []
    gap = False
    for c in text:
        if c in SPACES:
            gap = bool(out)
        elif not _control(c):
            new = [" ", c] if gap else [c]
            if len(out) + len(new) > most:
                return "".join(out) + "…"
            out += new
            gap = False
    return "".join(out)


def preview(text: Column, most: int = 160) -> Column:
    """:func:`preview_of` as a column, with built-in functions only."""
    spaces = "[\\t\\n\\x0B\\f\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
    flat = F.regexp_replace(F.regexp_replace(text, spaces, " "), "[\\x00-\\x1f\\x7f-\\x9f]", "")
    flat = F.trim(F.regexp_replace(flat, " {2,}", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit("…")))


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, "[\\x00-\\x1f\\x7f-\\x9f]", "")
