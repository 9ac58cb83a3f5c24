"""Structure-aware chunks of Markdown and plain text, addressed in bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Budgets in bytes, and the version that names them.
TARGET, SMALLEST, LARGEST, OVERLAP, RESERVE = 2048, 256, 4096, 256, 256
BYTES_PER_TOKEN = 4
VERSION = "3"

_LINE = re.compile(rb"[^\n]*\n|[^\n]+\Z")
_HEADING = re.compile(rb"(#{1,6}) (.*)\Z", re.S)
_FENCE = re.compile(rb" {0,3}(`{3,}|~{3,})")
_CELL = re.compile(rb"[ \t]*:?-+:?[ \t]*\Z")
_BLANK = b" \t\r\n\v\f"


@dataclass(frozen=True)
class Block:
    start: int
    end: int
    level: int = 0  # of a heading
    title: str = ""


@dataclass(frozen=True)
class Piece:
    start: int
    end: int
    path: tuple[str, ...]
    fixed: bool = False  # preamble and forced splits are never merged
    warning: str | None = None


def _bare(line: bytes) -> bytes:
    return line.removesuffix(b"\n").removesuffix(b"\r")


def _empty(line: bytes) -> bool:
    return not line.decode("utf-8", "replace").strip(" \t\r\n\v\f\x85\xa0")


def _is_delimiter(line: bytes) -> bool:
    s = line.strip(_BLANK)
    if b"-" not in s or b"|" not in s:
        return False
    return all(_CELL.match(c) for c in s.removeprefix(b"|").removesuffix(b"|").split(b"|"))


def _heading(line: bytes) -> tuple[int, str] | None:
    m = _HEADING.match(line)
    if not m:
        return None
    title = m[2].strip(_BLANK)
    open_end = title.rstrip(b"#")
    if not open_end or open_end.endswith(b" "):
        title = open_end.strip(_BLANK)
    return len(m[1]), title.decode("utf-8", "replace")


def blocks(raw: bytes) -> list[Block]:
    """Headings, fences, tables and paragraphs, without front matter and blank lines."""
    spans = [m.span() for m in _LINE.finditer(raw)]
    lines = [_bare(raw[a:z]) for a, z in spans]
    at = 0
    if lines and lines[0].rstrip(b" \t") == b"---":
        at = next((i + 1 for i in range(1, len(lines)) if lines[i].rstrip(b" \t") in (b"---", b"...")), 0)
    out: list[Block] = []
    run: int | None = None  # first line of the open paragraph

    def close(upto: int) -> None:
        nonlocal run
        if run is not None:
            out.append(Block(spans[run][0], spans[upto - 1][1]))
            run = None

    while at < len(lines):
        line, last = lines[at], at + 1
        if _empty(line):
            close(at)
        elif h := _heading(line):
            close(at)
            out.append(Block(*spans[at], *h))
        elif f := _FENCE.match(line):
            close(at)
            mark = f[1]
            shut = re.compile(rb" {0,3}" + re.escape(mark[:1]) + b"{%d,} *\\Z" % len(mark))
            while last < len(lines) and not shut.match(lines[last]):
                last += 1
            last = min(last + 1, len(lines))
            out.append(Block(spans[at][0], spans[last - 1][1]))
        elif b"|" in line and at + 1 < len(lines) and _is_delimiter(lines[at + 1]):
            close(at)
            last = at + 2
            while last < len(lines) and b"|" in lines[last]:
                last += 1
            out.append(Block(spans[at][0], spans[last - 1][1]))
        elif run is None:
            run = at
        at = last
    close(len(lines))
    return out


def room(ceiling: int, path: tuple[str, ...]) -> int:
    """Bytes that a chunk under ``path`` may have; 0: any number."""
    return max(64, ceiling - len(" > ".join(path).encode())) if ceiling > 0 else 0


def hard_split(raw: bytes, start: int, end: int, most: int) -> list[tuple[int, int]]:
    """Pieces of at most ``most`` bytes that keep every byte: cut after a blank line, a line, a blank, or a character."""
    out = []
    while end - start > most:
        view = raw[start : start + most]
        size = next((i + len(s) for s in (b"\n\n", b"\n", b" ") if (i := view.rfind(s)) >= 0), 0)
        if not size:
            size = most
            while size and raw[start + size] & 0xC0 == 0x80:
                size -= 1
            while not size or (start + size < end and raw[start + size] & 0xC0 == 0x80):
                size += 1
        out.append((start, start + size))
        start += size
    return [*out, (start, end)] if end > start else out


def _pack(raw: bytes, part: list[Block], path: tuple[str, ...], preamble: bool, ceiling: int) -> list[Piece]:
    limit = room(ceiling, path)
    cap = min(LARGEST, limit) if limit else LARGEST
    if part[-1].end - part[0].start <= cap:
        return [Piece(part[0].start, part[-1].end, path, preamble)]
    target, groups, first = min(TARGET, cap), [], 0
    for i, b in enumerate(part):
        if i > first and b.end - part[first].start > target:
            groups.append((first, i - 1))
            seed = i  # the trailing blocks that fit the overlap, never the whole group
            while seed - 1 > first and part[i - 1].end - part[seed - 1].start <= OVERLAP:
                seed -= 1
            first = i if b.end - part[min(seed, i)].start > cap else seed
    groups.append((first, len(part) - 1))
    out = []
    for a, z in groups:
        s, e = part[a].start, part[z].end
        if limit and e - s > limit:
            out += [Piece(x, y, path, True, "atomic block exceeds embedder input ceiling; split") for x, y in hard_split(raw, s, e, limit)]
        else:
            out.append(Piece(s, e, path, preamble))
    return out


def _common(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return a[:n]


def _merge_tiny(pieces: list[Piece], ceiling: int) -> list[Piece]:
    todo, at = list(pieces), 0
    while at < len(todo):
        me = todo[at]
        best: tuple[int, int] | None = None  # (shared headings, neighbour)
        if me.end - me.start < SMALLEST and not me.fixed:
            for k in (at - 1, at + 1):
                if not 0 <= k < len(todo) or todo[k].fixed or todo[k].end - todo[k].start < SMALLEST:
                    continue
                shared = _common(todo[k].path, me.path)
                size, limit = max(todo[k].end, me.end) - min(todo[k].start, me.start), room(ceiling, shared)
                if size <= LARGEST and (not limit or size <= limit) and (best is None or len(shared) > best[0]):
                    best = (len(shared), k)
        if best is None:
            at += 1
            continue
        k = best[1]
        todo[k] = replace(todo[k], start=min(todo[k].start, me.start), end=max(todo[k].end, me.end), path=_common(todo[k].path, me.path))
        del todo[at]
    return todo


def chunk(text: str, ceiling_tokens: int = 0) -> list[Piece]:
    """The chunks of a normalized text, in order; ``ceiling_tokens`` of 0 or less: no input ceiling."""
    raw = text.encode()
    ceiling = ceiling_tokens * BYTES_PER_TOKEN - RESERVE if ceiling_tokens > 0 else 0
    pieces: list[Piece] = []
    stack: list[tuple[int, str]] = []
    part: list[Block] = []
    seen = False
    for b in [*blocks(raw), Block(len(raw), len(raw), 1)]:
        if not b.level:
            part.append(b)
            continue
        if part:
            pieces += _pack(raw, part, tuple(t for _, t in stack), not seen, ceiling)
            part = []
        seen = True
        while stack and stack[-1][0] >= b.level:
            stack.pop()
        stack.append((b.level, b.title))
    return _merge_tiny(pieces, ceiling)


def chunk_texts(contents: DataFrame, hash_col: str = "content_hash", text_col: str = "text", ceiling_tokens: int = 0) -> DataFrame:
    """``(content_hash, ordinal, text, heading_path, byte_start, byte_end, warning)`` for one row per distinct content.

    Null and blank texts have no chunks, which is a legal end of their way through the pipeline.
    """
    kind = dict(contents.dtypes)[hash_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for h, t in zip(b["h"], b["t"]):
                raw = t.encode()
                for i, p in enumerate(chunk(t, ceiling_tokens)):
                    rows.append((h, i, raw[p.start : p.end].decode(), " > ".join(p.path), p.start, p.end, p.warning))
            yield pd.DataFrame(rows, columns=[hash_col, "ordinal", "text", "heading_path", "byte_start", "byte_end", "warning"])

    own = contents.select(F.col(hash_col).alias("h"), F.col(text_col).alias("t")).where("t is not null")
    return own.mapInPandas(run, f"`{hash_col}` {kind}, ordinal int, text string, heading_path string, byte_start long, byte_end long, warning string")
