"""The work queue: what is due, in which order, and what an attempt's outcome does to a content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumine.functions.stats import MOST_ATTEMPTS
from vellumine.schemas import terminal

OUTCOMES = ("indexed", "failed", "skipped", "transient", "changed", "superseded")
CHANGED_DELAY_S = 900


def due(content: DataFrame, now: int) -> DataFrame:
    return content.where(~terminal(F.col("state")) & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)))


def claim_batch(content: DataFrame, now: int, limit: int) -> DataFrame:
    """``limit`` due contents with ``slice`` and ``rank``: three quarters the newest, a quarter the oldest, each once.

    Two bounded top-k sorts; ties go by content hash in the direction of the slice.
    """
    old = limit // 4
    ready = due(content, now)
    newest = ready.orderBy(F.desc("updated_at"), F.desc("content_hash")).limit(limit - old).withColumn("slice", F.lit(0))
    oldest = ready.orderBy("updated_at", "content_hash").limit(old).withColumn("slice", F.lit(1))
    key = F.when(F.col("slice") == 0, -F.col("updated_at")).otherwise(F.col("updated_at"))
    both = newest.unionByName(oldest)
    one = both.withColumn("_k", F.row_number().over(Window.partitionBy("content_hash").orderBy("slice"))).where("_k = 1").drop("_k")
    # At most ``limit`` rows are left, so one window over all of them is bounded.
    order = Window.partitionBy("slice").orderBy(key, F.when(F.col("slice") == 0, F.lit(None)).otherwise(F.col("content_hash")), F.desc("content_hash"))
    return one.withColumn("rank", F.row_number().over(order).cast("long"))


def reschedule(content: DataFrame, tries: DataFrame, now: int) -> DataFrame:
    """``tries(content_hash, attempts, next_retry_at, error)`` written onto the content; the state is not touched."""
    t = tries.select("content_hash", F.col("attempts").alias("_a"), F.col("next_retry_at").alias("_n"), F.col("error").alias("_e"), F.lit(True).alias("_hit"))
    j = content.join(t, "content_hash", "left")
    new = {"attempts": F.col("_a"), "next_retry_at": F.col("_n"), "last_error": F.col("_e"), "updated_at": F.lit(now).cast("long")}
    return j.select(*(F.when(F.col("_hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in content.columns))


def apply_outcomes(content: DataFrame, outcomes: DataFrame, now: int, delay: Column | None = None, outage: bool = False) -> DataFrame:
    """The content after ``outcomes(content_hash, outcome, error)``.

    indexed, failed: that state. transient: one attempt more and a later retry, failed after the last; in an
    ``outage`` nothing is charged. changed: again after a quarter of an hour, attempts as they are. skipped and
    superseded: nothing. ``delay`` gives the seconds until a retry, half its window by default.
    """
    from vellumine.functions.stats import retry_window

    j = content.join(outcomes.select("content_hash", "outcome", F.col("error").alias("_error")), "content_hash", "left")
    o, tries = F.col("outcome"), F.col("attempts") + 1
    wait = delay if delay is not None else F.floor(retry_window(tries) / 2)
    charged = (o == "transient") & F.lit(not outage)
    spent = charged & (tries >= MOST_ATTEMPTS)
    state = F.when(o.isin("indexed", "failed"), o).when(spent, F.lit("failed")).otherwise(F.col("state"))
    retry = F.when(spent | o.isin("indexed", "failed"), F.lit(None)).when(charged, F.lit(now) + wait).when(o == "changed", F.lit(now + CHANGED_DELAY_S)).otherwise(F.col("next_retry_at"))
    error = F.when(spent, F.concat(F.col("_error"), F.lit(f" (after {MOST_ATTEMPTS} attempts)"))).when(charged | o.isin("failed", "changed"), F.col("_error")).when(o == "indexed", F.lit(None)).otherwise(F.col("last_error"))
    moved = charged | o.isin("indexed", "failed", "changed")
    new = {
        "state": state,
        "attempts": F.when(charged, tries).otherwise(F.col("attempts")).cast("int"),
        "next_retry_at": retry.cast("long"),
        "last_error": error,
        "updated_at": F.when(moved, F.lit(now)).otherwise(F.col("updated_at")).cast("long"),
    }
    return j.select(*((new[c].alias(c) if c in new else F.col(c)) for c in content.columns))
