"""Items over a size limit, cut into overlapping pieces at natural boundaries, by byte ranges.

Plan: an oversized item is spread over ranges of some 64 KB with halos on both
sides, so that no worker holds a whole item.  A first pass tells for each range
what its fence lines do to the open fence it begins with; put together in
order, a table of two short rows for each range, they say which fence is open
where a range's halo begins.  The second pass finds the boundaries of its
range, starts at the best boundary near the range's beginning (its neighbour
finds the same one through its halo) and emits pieces by offset.  Running sums
of the pieces in each range number them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumine.runtime import cut

LIMIT, OVERLAP, RANGE = 4096, 256, 65_536
_FENCE = re.compile(rb"(?m)^ {0,3}(`{3,}|~{3,})([^\n]*)")
_LEVELS = [
    (6, re.compile(r"\n[ \t\r]*\n[\s]*")),
    (6, re.compile(r"\n(?=#{1,6}[ \t])")),
    (5, re.compile(r"\r?\n")),
    (4, re.compile(r"[.!?…؟।]+[\"”»’)\]]*\s+|[。！？]+[」』”）]*")),
    (3, re.compile(r"[,;:]\s+|[、，；：]")),
    (2, re.compile(r"\s+")),
]
_CLUSTER = regex.compile(r"\X")


class Fence(NamedTuple):
    """A fence line: its byte offset, its sign and how often that stands there, whether it may open or close."""

    at: int
    sign: str
    size: int
    opens: bool
    closes: bool


Open = tuple[str, int] | None  # the sign and size of the fence that is open


def fence_lines(raw: bytes, at: int, start: int, stop: int) -> list[Fence]:
    """The fence lines that begin in [start, stop) of the item of which ``raw`` stands at ``at``."""
    out = []
    for m in _FENCE.finditer(raw):
        if start <= m.start() + at < stop:
            mark, rest = m[1].decode(), m[2]
            out.append(Fence(m.start() + at, mark[0], len(mark), not (mark[0] == "`" and b"`" in rest), not rest.strip()))
    return out


def step_fence(state: Open, f: Fence) -> Open:
    """What is open after a fence line: a fence is closed by a bare one of its own sign that is no shorter."""
    if state is None:
        return (f.sign, f.size) if f.opens else None
    return None if f.closes and f.sign == state[0] and f.size >= state[1] else state


def fence_summary(lines: list[Fence]) -> list[tuple[str, int, str, int]]:
    """``(sign, most, sign after, size after)``: what is open after the lines, for every fence that may be open before.

    A row holds for open fences of its sign of up to ``most``; the row of no sign for none open. Larger ones stay open.
    """

    def run(lines: list[Fence]) -> tuple[str, int]:
        state: Open = None
        for f in lines:
            state = step_fence(state, f)
        return state or ("", 0)

    out = [("", 0, *run(lines))]
    for sign in "`~":
        longest = 0
        for i, f in enumerate(lines):
            if f.sign == sign and f.closes and f.size > longest:
                out.append((sign, f.size, *run(lines[i + 1 :])))
                longest = f.size
    return out


def apply_summary(state: Open, summary: list) -> Open:
    sign, size = state or ("", 0)
    for own, most, after, n in summary:
        if own == sign and size <= most:
            return (after, int(n)) if after else None
    return state


class _Range:
    """The decoded slice of a range: places that may be cut, by byte offset in the item."""

    def __init__(self, raw: bytes, at: int, state: Open, start: int):
        skip = 0
        while skip < min(4, len(raw)) and raw[skip] & 0xC0 == 0x80:
            skip += 1
        self.text = raw[skip:].decode("utf-8", "ignore")
        code = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        width = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        self.byte = np.concatenate([[0], np.cumsum(width)]) + at + skip
        self.raw, self.at = raw, at
        level = np.zeros(len(self.byte), np.int8)
        for n, p in reversed(_LEVELS):
            for m in p.finditer(self.text):
                level[m.end()] = n
        for m in re.finditer(r"(?m)^[ \t]*\|[^\n]*\n(?=[ \t]*\|)", self.text):  # between rows of a table
            level[m.end()] = min(level[m.end()], 3)
        # Inside fences every level falls by three, so that code is cut only where nothing else will do.
        last, inside = 0, state is not None
        edges: list[int] = []
        for f in fence_lines(raw, at, start, at + len(raw)):
            after = step_fence(state, f)
            if (after is None) != (state is None):
                edges.append(int(np.searchsorted(self.byte, f.at)))
            state = after
        for e in [*edges, len(level)]:
            if inside:
                level[last + 1 : e] = np.where(level[last + 1 : e] > 1, np.maximum(1, level[last + 1 : e] - 3), level[last + 1 : e])
            last, inside = e, not inside
        self.level = level
        self.clusters: np.ndarray | None = None

    def _between(self, lo: int, hi: int) -> tuple[int, int]:
        return int(np.searchsorted(self.byte, lo)), int(np.searchsorted(self.byte, hi, "right"))

    def best(self, lo: int, hi: int, early: bool) -> int | None:
        """The byte offset of the highest level in [lo, hi], the first or last of them; None without any."""
        a, z = self._between(lo, hi)
        if a >= z:
            return None
        part = self.level[a:z]
        top = part.max()
        if top < 1:
            return None
        k = np.nonzero(part == top)[0]
        return int(self.byte[a + (k[0] if early else k[-1])])

    def cluster(self, lo: int, hi: int) -> int | None:
        """The last boundary between user-perceived characters in (lo, hi], or between code points."""
        a, z = self._between(lo + 1, hi)
        if self.clusters is None:
            self.clusters = np.asarray([m.end() for m in _CLUSTER.finditer(self.text)], np.int64)
        k = self.clusters[(self.clusters >= a) & (self.clusters < z)]
        if len(k):
            return int(self.byte[k[-1]])
        return int(self.byte[z - 1]) if z > a else None


def first_cut(r: _Range, start: int, total: int, budget: int) -> int:
    """Where the pieces of the range that begins at ``start`` begin; the same from either side."""
    if start <= 0 or start >= total:
        return max(0, min(start, total))
    end = min(total, start + budget // 2)
    got = r.best(start, end, early=True)
    return got if got is not None else (r.cluster(start - 1, end) or start)


def cuts(r: _Range, start: int, stop: int, total: int, budget: int, overlap: int) -> list[tuple[int, int]]:
    """(begin, end) byte offsets of the pieces of a range; each takes up to ``overlap`` bytes from the one before it."""
    at, end = first_cut(r, start, total, budget), first_cut(r, stop, total, budget) if stop < total else total
    out: list[tuple[int, int]] = []
    while at < end:
        begin = at
        if at > 0 and overlap:
            lead = r.best(max(r.byte[0], at - overlap), at - 1, early=True)
            begin = at if lead is None else lead
        room = begin + budget
        if end <= room:
            nxt = end
        else:
            hi = min(room, at + int(0.6 * (end - at))) if end - at < 1.5 * budget else room
            nxt = r.best(at + max(1, (hi - at) // 2), hi, early=False) or r.best(at + 1, hi, early=False)
            if nxt is None:
                nxt = r.cluster(at, room) or min(room, end)
        if nxt <= at:
            begin, nxt = at, min(end, at + budget)
        out.append((begin, nxt))
        at = nxt
    return out


def shorten_heading(path: str, most: int) -> str:
    """A heading path of at most ``most`` bytes: leading headings go first, then leading characters of the last."""
    while len(path.encode()) > most and " > " in path:
        path = path.split(" > ", 1)[1]
    raw = path.encode()
    return path if len(raw) <= most else raw[len(raw) - most :].decode("utf-8", "ignore")


def _ranges(size: Column, step: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(size - 1, F.lit(0)).cast("long"), F.lit(step).cast("long")))


def _emit(ranges: DataFrame, limit: int, overlap: int, step: int, halo: int, id_type: str) -> DataFrame:
    """Pieces of ranges (i, n, r, size, base, heading, low, raw); ``raw`` stands at ``low``, a byte before the halo."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for n, r, low, raw in zip(b["n"], b["r"], b["low"], b["raw"]):
                for a, z in ((r, r + step - halo), (r + step - halo, r + step)):  # the halo of the range after this begins between them
                    s = fence_summary(fence_lines(raw, low, a, z))
                    rows.append((n, r, a, *([x[k] for x in s] for k in range(4))))
            yield pd.DataFrame(rows, columns=["n", "r", "a", "s", "m", "t", "k"])

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The fence that is open where the halo of each range begins: a fold over rows in the order of (n, a)."""
        item, at, state = None, -1, None
        for b in batches:
            out = []
            for n, a, s, m, t, k in zip(b["n"], b["a"], b["s"], b["m"], b["t"], b["k"]):
                if n != item:
                    item, at, state = n, -1, None
                    out.append((n, 0, "", 0))
                if a == at:  # a repeated row
                    continue
                at = a
                if a % step:
                    out.append((n, a + halo, state[0] if state else "", state[1] if state else 0))
                state = apply_summary(state, list(zip(s, m, t, k)))
            yield pd.DataFrame(out, columns=["n", "r", "sign", "open"])

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, n, r, size, base, heading, low, raw, sign, fence in zip(b["i"], b["n"], b["r"], b["size"], b["base"], b["heading"], b["low"], b["raw"], b["sign"], b["open"]):
                path = shorten_heading(heading or "", limit // 2)
                budget = limit - len(path.encode())
                g = _Range(raw, low, (sign, int(fence)) if sign else None, max(0, r - halo))
                for j, (a, z) in enumerate(cuts(g, r, min(size, r + step), size, budget, overlap)):
                    rows.append((i, n, r, j, raw[a - low : z - low].decode("utf-8", "replace"), path, base + a, base + z))
            yield pd.DataFrame(rows, columns=["i", "n", "r", "j", "text", "heading_path", "byte_start", "byte_end"])

    parts = ranges.select("n", "r", "low", "raw").mapInPandas(summarise, "n string, r long, a long, s array<string>, m array<long>, t array<string>, k array<long>")
    before = parts.select("n", "a", "s", "m", "t", "k").repartition("n").sortWithinPartitions("n", "a").mapInPandas(states, "n string, r long, sign string, open long")
    return ranges.join(before, ["n", "r"]).mapInPandas(emit, f"i {id_type}, n string, r long, j int, text string, heading_path string, byte_start long, byte_end long")


def split_oversized(
    items: DataFrame,
    id_col: str = "id",
    text_col: str = "text",
    heading_col: str = "heading_path",
    start_col: str | None = "byte_start",
    limit: int = LIMIT,
    overlap: int = OVERLAP,
    step: int = RANGE,
) -> DataFrame:
    """``(id, piece, text, heading_path, byte_start, byte_end)`` of every item whose text and heading exceed ``limit`` bytes.

    Text and heading path of a piece have at most ``limit`` bytes together; it begins up to ``overlap`` bytes
    before the end of the piece before it, and its span is in bytes from ``start_col`` (0 without one). Cuts
    prefer blank lines and headings, then lines, sentences, clauses and spaces, then user-perceived characters;
    code is cut last. A heading of more than half the limit loses its leading part. Null texts count as empty,
    null headings as none; items within the limit, and empty tables, give no rows; an item whose heading alone
    is too large gives one piece without text; repeated rows are split each for themselves but numbered as one
    if all their columns are equal. Other columns are not read.
    """
    kind = dict(items.dtypes)[id_col]
    halo = limit + 1024
    step = max(step, 2 * halo)
    text, heading = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(heading_col), F.lit(""))
    size = F.octet_length(text).cast("long")
    base = F.coalesce(F.col(start_col), F.lit(0)).cast("long") if start_col else F.lit(0).cast("long")
    big = items.where(size + F.octet_length(heading) > limit)
    # n tells rows apart that bear the same id, and is never null
    big = big.select(F.col(id_col).alias("i"), F.concat_ws(":", F.hex(F.xxhash64(text, heading, base)), F.col(id_col).cast("string")).alias("n"), text.cast("binary").alias("b"), heading.alias("heading"), base.alias("base"), size.alias("size"))
    ranges = big.select("i", "n", "b", "heading", "base", "size", _ranges(F.col("size"), step).alias("r"))
    low = F.greatest(F.col("r") - halo - 1, F.lit(0))
    slice_ = F.substring(F.col("b"), (low + 1).cast("int"), (F.col("r") + step + halo - low).cast("int"))
    ranges = ranges.select("i", "n", "r", "size", "base", "heading", low.alias("low"), slice_.alias("raw"))
    return _numbered(_emit(ranges, limit, overlap, step, halo, kind), big.where("size = 0"), id_col, limit)


def _numbered(pieces: DataFrame, bare: DataFrame | None, id_col: str, limit: int) -> DataFrame:
    pieces = cut(pieces)
    counts = pieces.groupBy("n", "r").agg(F.countDistinct("j").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("n").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select("n", "r", before.alias("first"))
    out = pieces.join(first, ["n", "r"]).select(F.col("i").alias(id_col), (F.col("first") + F.col("j")).cast("int").alias("piece"), "text", "heading_path", "byte_start", "byte_end")
    if bare is None:
        return out
    short = F.udf(lambda h: shorten_heading(h, limit // 2), "string")
    return out.unionByName(bare.select(F.col("i").alias(id_col), F.lit(0).alias("piece"), F.lit("").alias("text"), short("heading").alias("heading_path"), F.col("base").alias("byte_start"), F.col("base").alias("byte_end")))


def split_files(spark: SparkSession, files: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, step: int = RANGE) -> DataFrame:
    """The same for UTF-8 files ``(path, size)``: each range is read by offset, no file as a whole.

    ``path`` is a path that all workers see, or the address of a file system that Arrow reads (HDFS and object stores).
    """
    halo = limit + 1024
    step = max(step, 2 * halo)
    ranges = files.where(F.col("size") > limit).select(F.col("path").alias("i"), F.col("path").alias("n"), F.col("size").cast("long").alias("size"), _ranges(F.col("size"), step).alias("r"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raws, lows = [], []
            for path, r in zip(b["i"], b["r"]):
                low = max(0, r - halo - 1)
                fs, name = FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path)
                with fs.open_input_file(name) as f:
                    raws.append(f.read_at(r + step + halo - low, low))
                lows.append(low)
            yield b.assign(base=np.int64(0), heading="", low=lows, raw=raws)

    ranges = ranges.repartition(F.col("i"), F.col("r")).mapInPandas(read, "i string, n string, size long, r long, base long, heading string, low long, raw binary")
    return _numbered(_emit(ranges, limit, overlap, step, halo, "string"), None, "path", limit)
