"""Mixing sources to target weights by a low-discrepancy schedule.

Plan: tokens are counted once in a narrow map; places of documents in their
source's shuffled order, and of slots in their source's turn, are running sums
that are taken first within hash buckets, then over the small table of bucket
totals, so that no task ever sees a whole source.  Golden-ratio points mapped
through the cumulative weights give every slot its source, and slots meet the
equal-token blocks of their source in one join.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumine.runtime import cut, spread

GOLDEN = 0.6180339887498949
#: Words, numbers and signs are split as byte-level BPE vocabularies expect it.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

_encoders: dict[str, object] = {}


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_tokens(docs: DataFrame, keep: list[str], text_col: str, tokenizer: str) -> DataFrame:
    """``keep`` and ``n_tokens``; null texts have none. The vocabulary file must lie at the same path on all workers."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(tokenizer)
        for b in batches:
            yield b[keep].assign(n_tokens=[len(enc.encode_ordinary(t)) if t else 0 for t in b["_text"]])

    own = docs.select(*keep, F.col(text_col).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields if f.name != "_text")
    return spread(own).mapInPandas(count, f"{fields}, n_tokens long")


def running_sum(df: DataFrame, by: str, order: Column, bucket: Column, value: str, out: str) -> DataFrame:
    """``df`` and ``out``: the sum of ``value`` over the rows of the same ``by`` before this one in (bucket, order).

    Buckets must be monotone in the order; each is one window, their totals are one small table.
    """
    d = df.withColumn("_b", bucket).withColumn("_o", order)
    totals = d.groupBy(by, "_b").agg(F.sum(value).alias("_t"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    inner = F.coalesce(F.sum(value).over(Window.partitionBy(by, "_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("_inner", inner).join(before, [by, "_b"]).withColumn(out, F.col("_before") + F.col("_inner")).drop("_b", "_o", "_inner", "_before")


def source_name(c: Column) -> Column:
    return F.lower(F.trim(c))


def mix(
    documents: DataFrame,
    targets: DataFrame,
    tokenizer: str,
    total_tokens: int | None = None,
    block_tokens: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 11,
    bucket_rows: int = 65_536,
) -> tuple[DataFrame, DataFrame]:
    """``(mixture, report)``.

    mixture: ``(slot, place, source, doc_id, epoch, n_tokens, text)``, one row for each use of a document, to be
    read in the order of (slot, place). report: ``(source, target_share, actual_share, tokens, documents,
    repeats, max_repeats)`` for every target and every source of the documents.

    ``tokenizer`` is the path of a tiktoken vocabulary file, the same on all workers. Sources are compared without case and outer blanks. Without ``total_tokens`` the mixture is as large as all
    targets can be met exactly within ``max_repeats``; with it, sources that run out give less than their share.
    Targets without documents, or with a share or repeats of 0 or null, give nothing, and the others share in
    proportion; documents without a target source, with null ids or without tokens are left out and reported.
    Blocks are whole documents that begin within the same ``block_tokens`` tokens of their source's shuffled
    order, so a source misses its share by less than two blocks; by default a 2,000th of the mixture, at most 65,536 tokens.
    Several targets of one name are added up, with the smallest of their ``max_repeats``. Rows that repeat an id
    are used as one. Empty tables give an empty mixture.
    """
    spark = documents.sparkSession
    docs = documents.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("d"), source_name(F.col(source_col)).alias("source"), F.col(text_col).alias("x"))
    sized = count_tokens(docs, ["d", "source"], "x", tokenizer).groupBy("d").agg(F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens"))
    sized = cut(sized)  # counting is the dear step; ids, sources and numbers only
    want = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    have = sized.where("n_tokens > 0 and source is not null").groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    # One row for each target: the list of targets is the caller's, its length does not grow with the documents.
    plan = [r for r in want.join(have, "source").orderBy("source").collect() if (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0]
    whole = sum(r["target_share"] for r in plan)
    most = min((r["max_repeats"] * r["t"] * whole / r["target_share"] for r in plan), default=0.0)
    total = most if total_tokens is None else float(total_tokens)
    block = block_tokens or max(1, min(65_536, int(total // 2000)))
    slots = int(total // block)
    edges, at = [], 0.0
    for r in plan:
        edges.append((r["source"], at, at + r["target_share"] / whole, r["max_repeats"], r["t"]))
        at = edges[-1][2]
    if edges:
        edges[-1] = (*edges[-1][:2], 1.0, *edges[-1][3:])
    rows = [(s, min(m, int((z - a) * total // t) + 2), t) for s, a, z, m, t in edges]
    epochs = spark.createDataFrame(rows, "source string, epochs int, t long")
    used = sized.where("n_tokens > 0").join(F.broadcast(epochs), "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    # As many buckets as leave ``bucket_rows`` rows of the largest source in each, so that no window grows with the data.
    buckets = 1 << max(0, (max((r["n"] for r in plan), default=1) // bucket_rows)).bit_length()
    h = F.xxhash64(F.lit(seed), F.col("epoch"), F.col("d"))
    bucket = F.col("epoch") * buckets + F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(buckets - 1))
    placed = running_sum(used, "source", F.struct(h, F.col("d")), bucket, "n_tokens", "start")
    blocks = placed.select("source", "d", "epoch", "n_tokens", F.floor(F.col("start") / block).alias("rank"), (F.col("start") % block).alias("place"))
    point = (F.col("id") * F.lit(GOLDEN)) % F.lit(1.0)
    choose = F.lit(None).cast("string")
    for s, a, z, *_ in reversed(edges):
        choose = F.when((point >= a) & (point < z), F.lit(s)).otherwise(choose)
    turn = spark.range(slots).select(F.col("id").alias("slot"), choose.alias("source"), F.lit(1).cast("long").alias("one"))
    turn = running_sum(turn, "source", F.col("slot"), F.floor(F.col("slot") / 65_536), "one", "rank").select("slot", "source", "rank")
    chosen = cut(blocks.join(turn, ["source", "rank"]).select("slot", "place", "source", F.col("d").alias(id_col), "epoch", "n_tokens"))
    got = chosen.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct(id_col).alias("documents"), (F.max("epoch") + 1).alias("repeats"))
    whole_ = got.agg(F.sum("tokens").alias("all"))
    names = want.select("source").union(sized.select("source")).distinct()
    report = names.join(want, F.expr("true") & names["source"].eqNullSafe(want["source"]), "left").select(names["source"], "target_share", "max_repeats").join(got, "source", "left").join(F.broadcast(whole_))
    report = report.select(
        "source",
        "target_share",
        F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("actual_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("repeats", F.lit(0)).alias("repeats"),
        "max_repeats",
    )
    texts = documents.select(F.col(id_col), F.col(text_col).alias("text"))
    texts = texts.join(chosen.select(id_col).distinct(), id_col, "left_semi").groupBy(id_col).agg(F.max("text").alias("text"))
    return chosen.join(texts, id_col).select("slot", "place", "source", id_col, "epoch", "n_tokens", "text"), report
