"""Held-out passages inside training documents: find, report and remove.

Plan: the passages become a hash table of pairs of their content words (next to each other, or with one between), which
is broadcast in blocks of a bounded number of words; every document is scanned
once per block by a narrow Arrow map (no shuffle, nothing kept but the hits),
seeds are extended to aligned runs, and a run counts when it spans enough words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.runtime import spread

# Small words, which may be exchanged without making another text.
SMALL = frozenset(
    "a about above across after against all along also although am among an and any are around as at be because been before behind "
    "being below beneath beside besides between beyond both but by can could did do does down during each either every few for from "
    "get gets got had has have he her here hers him his how i if in inside into is it its later latter like many may me might more "
    "most much must my near neither no nobody nor not of off on once one only onto or other our out outside over past per plus same "
    "shall she should since so some such than that the their them then there these they this those though through throughout till to "
    "too toward towards under underneath until up upon us very via was we were what when where which while who whom whose why will "
    "with within without would yet you your following held somebody someone anyone everyone none also again next".split()
)
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿]|[^\W぀-ヿ㐀-鿿](?:[^\W぀-ヿ㐀-鿿]|[̀-ͯ­])*(?:[-­‐][ \t]*\r?\n[>\s]*[^\W\d_A-Z](?:[^\W_]|[̀-ͯ])*)*")
_JOIN = re.compile(r"[-­‐][ \t]*\r?\n[>\s]*")
_cache: dict[str, str] = {}


def _norm(raw: str) -> str:
    """A word without case, accents, soft hyphens and line breaks."""
    got = _cache.get(raw)
    if got is None:
        if len(_cache) > 300_000:
            _cache.clear()
        s = _JOIN.sub("", raw).replace("­", "").replace("_", "").lower()
        if not s.isascii():
            s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
        got = _cache[raw] = s
    return got


def _similar(a: str, b: str, named: bool = False) -> bool:
    """One slip of the pen: at most two letters differ in a word of six or more, one in a shorter one or a name."""
    if a == b:
        return True
    least = min(len(a), len(b))
    if least < 3 or (a[0] != b[0] and a[-1] != b[-1]) or max(len(a), len(b)) - least > 2 or (a.isdigit() and b.isdigit()):
        return False  # words that differ at both ends differ in more than two letters
    most = 2 if least >= 6 and not named else 1
    i = 0
    while i < least and a[i] == b[i]:
        i += 1
    j = 0
    while j < least - i and a[-1 - j] == b[-1 - j]:
        j += 1
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    if len(x) == len(y) == 2 and x == y[::-1]:
        return True
    return max(len(x), len(y)) <= most


class PassageIndex:
    """Content-word pairs of a bounded block of passages; small enough to broadcast."""

    def __init__(self, rows: list[tuple[int, str]], n: int = 3, least: int = 12):
        self.n, self.least = n, least
        self.words: dict[int, list[str]] = {}
        self.content: dict[int, list[int]] = {}
        self.phrase: dict[int, list[str]] = {}
        self.named: dict[int, list[bool]] = {}
        self.grams: dict[int, dict[str, dict[str, list[tuple[int, int]]]]] = {1: {}, 2: {}}  # by gap and the two words
        for key, (_, text) in enumerate(rows):
            found = [m.group() for m in _TOKEN.finditer(text or "")]
            w = [_norm(x) for x in found]
            at = [i for i, x in enumerate(w) if x not in SMALL]
            self.words[key], self.content[key] = w, at
            self.named[key] = [w[i].isdigit() or (i > 0 and found[i][:1].isupper()) for i in at]
            c = self.phrase[key] = [w[i] for i in at]
            for gap in (1, 2):
                for i in range(len(c) - gap):
                    self.grams[gap].setdefault(c[i], {}).setdefault(c[i + gap], []).append((key, i))
        self.items = [i for i, _ in rows]
        # Stretches that are long enough but have too few content words for an alignment: looked up as they are.
        self.plain: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for key, w in self.words.items():
            size = min(least, len(w))
            for i in range(len(w) - size + 1 if w else 0):
                if sum(x not in SMALL for x in w[i : i + size]) < n:
                    self.plain.setdefault(size, {}).setdefault(hash(tuple(w[i : i + size])), []).append((key, i))

    def scan(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """``(item, number of the run, first char, end char, words of the passage covered)`` of every run of every passage held, the longest of an item first."""
        if not text:
            return []
        raw = _TOKEN.findall(text)
        words = [_norm(x) for x in raw]
        at = [i for i, x in enumerate(words) if x not in SMALL]
        c = [words[i] for i in at]
        seeds: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for gap in (1, 2):
            firsts = self.grams[gap]
            for i, (a, b) in enumerate(zip(c, c[gap:])):
                if a in firsts and b in (seconds := firsts[a]):
                    for key, j in seconds[b]:
                        seeds[key].append((i, j, gap))
        runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for size, known in self.plain.items():
            for i in range(len(words) - size + 1):
                for key, j in known.get(hash(tuple(words[i : i + size])), ()):
                    if words[i : i + size] == self.words[key][j : j + size]:
                        z = size
                        while i + z < len(words) and j + z < len(self.words[key]) and words[i + z] == self.words[key][j + z]:
                            z += 1
                        runs[key].append((z, i, i + z - 1))
        if not seeds and not runs:
            return []
        for key, found in seeds.items():
            total = len(self.words[key])
            need = min(self.least, total)
            done: set[tuple[int, int]] = set()
            for i, j, gap in found:
                if (i, j) in done and (i + gap, j + gap) in done:
                    continue
                pairs = self._extend(c, key, i, j, gap)
                done.update(pairs)
                run = self._span(words, at, key, pairs)
                if run and run[0] >= need:
                    runs[key].append(run)
        if not runs:
            return []
        spans = [m.span() for m in _TOKEN.finditer(text)]
        out = []
        for key in sorted(runs):
            kept: list[tuple[int, int, int]] = []
            for covered, a, z in sorted(set(runs[key]), key=lambda r: (-r[0], r[1], r[2])):
                if all(z < b or a > y for _, b, y in kept):  # other alignments of the same words are the same run
                    kept.append((covered, a, z))
            out += [(self.items[key], n, spans[a][0], spans[z][1], covered) for n, (covered, a, z) in enumerate(kept)]
        return out

    def _extend(self, c: list[str], key: int, i: int, j: int, gap: int) -> list[tuple[int, int]]:
        """Aligned content words around a seed: equal or misspelt words, single other words in between."""
        p, named = self.phrase[key], self.named[key]
        n, m = len(c), len(p)
        out = [(i, j), (i + gap, j + gap)]
        if gap == 2:
            if _similar(c[i + 1], p[j + 1], named[j + 1]):
                out.append((i + 1, j + 1))
            elif named[j + 1] or c[i + 1].isdigit():
                return out
        for step in (1, -1):
            x, y = (i + gap + 1, j + gap + 1) if step == 1 else (i - 1, j - 1)
            clean = 1  # words matched since the last slip
            while 0 <= x < n and 0 <= y < m:
                if c[x] == p[y] or _similar(c[x], p[y], named[y]):
                    out.append((x, y))
                    x, y, clean = x + step, y + step, clean + 1
                    continue
                x1, y1 = x + step, y + step
                inx, iny = 0 <= x1 < n, 0 <= y1 < m
                if clean < 1:
                    break
                if inx and iny and _similar(c[x1], p[y1], named[y1]) and not named[y] and not c[x].isdigit():
                    x, y, clean = x1, y1, 0
                elif inx and _similar(c[x1], p[y], named[y]) and not c[x].isdigit():
                    x, clean = x1, 0
                elif iny and _similar(c[x], p[y1], named[y1]) and not named[y]:
                    y, clean = y1, 0
                else:
                    break
        return out

    def _span(self, words: list[str], at: list[int], key: int, pairs: list[tuple[int, int]]) -> tuple[int, int, int] | None:
        pw, pat = self.words[key], self.content[key]
        pairs.sort()
        exact = [q for q in pairs]
        a, b = exact[0], exact[-1]
        slips = max(b[1] - a[1], b[0] - a[0]) + 1 - len(exact)
        if slips * 3 > len(exact) or len(exact) < self.n:
            return None
        da, db, pa, pb = at[a[0]], at[b[0]], pat[a[1]], pat[b[1]]
        swapped = False  # one exchanged small word at either edge
        while da > 0 and pa > 0 and (words[da - 1] == pw[pa - 1] or not swapped and words[da - 1] in SMALL and pw[pa - 1] in SMALL):
            swapped |= words[da - 1] != pw[pa - 1]
            da, pa = da - 1, pa - 1
        swapped = False
        while db + 1 < len(words) and pb + 1 < len(pw) and (words[db + 1] == pw[pb + 1] or not swapped and words[db + 1] in SMALL and pw[pb + 1] in SMALL):
            swapped |= words[db + 1] != pw[pb + 1]
            db, pb = db + 1, pb + 1
        facts = sum(self.named[key][j] and words[at[i]] == pw[pat[j]] for i, j in exact)
        if slips >= max(1, facts) and pb - pa + 1 < self.least + 4:  # barely long enough: more names and numbers must agree than words were exchanged, else the shape alone is shared
            return None
        return pb - pa + 1, da, db


def find_leaks(
    documents: DataFrame,
    passages: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    passage_col: str = "text",
    least_words: int = 12,
    n: int = 3,
    block_words: int = 200_000,
) -> DataFrame:
    """``(doc_id, item_id, run, start_char, end_char, words)``: each place in a document that holds a passage, wholly or for ``least_words`` words.

    ``run`` numbers the places of an item in a document from 0, the longest first.

    The passages are the stated query set: they are read to the driver in blocks of at most
    ``block_words`` words (about 40 MB of index), and every block is compared with all documents.
    A passage shorter than ``least_words`` counts only as a whole. Stretches with fewer than ``n`` content words have
    to stand as they are, word by word.
    Passages or documents that are null or empty give no rows; a null id is kept; repeated document rows are
    reported once for each; repeated items likewise.  Columns other than those named are not read.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where(F.col("_t").isNotNull() & (F.col("_t") != ""))
    kind = dict(documents.dtypes)[id_col]
    item_kind = dict(passages.dtypes)[item_col]
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, run int, start_char long, end_char long, words int"
    out: DataFrame | None = None

    def flush(rows: list[tuple[int, str]]) -> DataFrame:
        index = spark.sparkContext.broadcast(rows)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = PassageIndex(index.value, n, least_words)  # built in the worker: string hashes differ between processes
            for b in batches:
                hits = [(i, *h) for i, t in zip(b["_id"], b["_t"]) for h in own.scan(t)]
                yield pd.DataFrame(hits, columns=[id_col, item_col, "run", "start_char", "end_char", "words"])

        return spread(docs).mapInPandas(scan, schema)

    block: list[tuple[int, str]] = []
    size = 0
    rows = passages.select(F.col(item_col).alias("i"), F.col(passage_col).alias("t")).where(F.col("t").isNotNull())
    for r in rows.toLocalIterator():
        words = r["t"].count(" ") + 1
        if block and size + words > block_words:
            out = flush(block) if out is None else out.unionByName(flush(block))
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += words
    last = flush(block) if block or out is None else None
    return last if out is None else out if last is None else out.unionByName(last)


def remove_leaks(documents: DataFrame, leaks: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_documents: bool = False) -> DataFrame:
    """``documents`` without the leaked spans, or without the documents that have any (``whole_documents``).

    All runs of all items are cut, overlapping ones once. ``documents`` must have one row per id; other columns stay as they are.
    """
    if whole_documents:
        return documents.join(leaks.select(id_col).distinct(), id_col, "left_anti").select(documents.columns)
    spans = leaks.groupBy(id_col).agg(F.array_sort(F.collect_set(F.struct("start_char", "end_char"))).alias("_spans"))
    kept = F.aggregate(
        F.col("_spans"),
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end_char"]).alias("at"),
            F.concat(a["text"], F.when(s["start_char"] > a["at"], F.col(text_col).substr((a["at"] + 1).cast("int"), (s["start_char"] - a["at"]).cast("int"))).otherwise(F.lit(""))).alias("text"),
        ),
        lambda a: F.concat(a["text"], F.col(text_col).substr((a["at"] + 1).cast("int"), F.length(text_col))),
    )
    return documents.join(spans, id_col, "left").withColumn(text_col, F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(kept)).select(documents.columns)
