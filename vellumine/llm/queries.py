"""Queries of the language-model data operators, by the names the driver calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumine.llm.encoding import garbled_ids, repair_and_restore
from vellumine.llm.leakage import find_leaks, remove_leaks
from vellumine.llm.markup import clean_markup, markup_found
from vellumine.llm.mixing import mix
from vellumine.llm.neighbours import similar_pairs, similar_vectors
from vellumine.llm.pieces import split_oversized
from vellumine.llm.sentences import sentence_units
from vellumine.runtime import table


#: A public byte-level vocabulary; another one is named by the session's setting ``vellumine.tokenizer``.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def _tokenizer(spark: SparkSession) -> str:
    return spark.conf.get("vellumine.tokenizer", TOKENIZER)


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf_dir, "vectors"), table(spark, sf_dir, "chunks"), table(spark, sf_dir, "generations")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = similar_vectors(*_vectors(spark, sf_dir), k=5, max_distance=0.12)
    return similar_pairs(near.where("distance <= 0.12"))


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(*_vectors(spark, sf_dir), k=5)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup_found(table(spark, sf_dir, "chunks")).withColumnRenamed("id", "chunk_id")


def p2_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_markup(table(spark, sf_dir, "chunks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_ids(table(spark, sf_dir, "chunks")).toDF("chunk_id")


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_and_restore(table(spark, sf_dir, "chunks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "chunks")).select(F.col("id").alias("chunk_id")).distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "chunks"))


def p5_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts put together again from their pieces, and whether sizes and overlaps keep to their bounds."""
    p = split_oversized(table(spark, sf_dir, "chunks"))
    before = F.lag("byte_end").over(Window.partitionBy("id").orderBy("piece"))
    over = F.greatest(F.coalesce(before - F.col("byte_start"), F.lit(0)), F.lit(0))
    raw = F.col("text").cast("binary")
    p = p.select("id", "piece", over.alias("o"), raw.alias("raw"), (F.octet_length("text") + F.octet_length("heading_path")).alias("size"), (F.coalesce(before, F.col("byte_start")) - F.col("byte_start")).between(0, 256).alias("fine"))
    own = F.struct("piece", F.hex(F.substring("raw", F.col("o").cast("int") + 1, F.octet_length("raw"))).alias("x"))
    g = p.groupBy("id").agg(F.array_sort(F.collect_list(own)).alias("l"), (F.max("size") <= 4096).alias("within"), F.min("fine").alias("overlaps"))
    return g.select(F.col("id").alias("chunk_id"), F.sha2(F.unhex(F.array_join(F.col("l.x"), "")), 256).alias("text_hash"), "within", "overlaps")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_passages")).where("run = 0").select("doc_id", "item_id")


def p6_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the leaked spans; ``cut_chars`` tells how much is gone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").alias("before"))
    left = remove_leaks(docs, find_leaks(docs, table(spark, sf_dir, "eval_passages")))
    return left.select("doc_id", "text", (F.col("before") - F.length("text")).cast("long").alias("cut_chars"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), _tokenizer(spark))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), _tokenizer(spark))[1]


def p7_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each target: whether its share is met but for two of the longest documents, and its repeats keep to their bound."""
    mixture, report = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), _tokenizer(spark))
    r = report.where("target_share is not null")
    whole = r.agg(F.sum(F.when(F.col("documents") > 0, F.col("target_share"))).alias("whole"), F.sum("tokens").alias("all"))
    longest = mixture.agg(F.max("n_tokens").alias("longest"))
    r = r.join(F.broadcast(whole)).join(F.broadcast(longest))  # one row each
    apart = F.abs(F.col("tokens") - F.col("target_share") / F.col("whole") * F.col("all"))
    return r.select("source", ((F.col("documents") > 0) & (apart <= 2 * F.col("longest") + F.col("all") / 1000)).alias("share_met"), (F.col("repeats") <= F.col("max_repeats")).alias("repeats_met"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(table(spark, sf_dir, "documents"), with_text=False)


def p8_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(table(spark, sf_dir, "documents"))


P1_SQL = """WITH g AS (SELECT generation, dims FROM generations ORDER BY generation DESC LIMIT 1),
live AS (SELECT chunk_id AS id, min(embedding::DOUBLE[]) AS e FROM vectors v, g WHERE v.generation = g.generation AND len(v.embedding) = g.dims
  AND chunk_id IN (SELECT id FROM chunks) AND NOT list_bool_or(list_transform(v.embedding, lambda x: isnan(x))) AND list_bool_or(list_transform(v.embedding, lambda x: x <> 0)) GROUP BY chunk_id),
near AS (SELECT a.id AS a, b.id AS b, list_cosine_distance(a.e, b.e) AS d FROM live a, live b WHERE a.id <> b.id),
five AS (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY round(d, 9), b) AS r FROM near WHERE d <= 0.12)
SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM five WHERE r <= 5"""

P5_SQL = "SELECT id AS chunk_id FROM chunks WHERE strlen(coalesce(text, '')) + strlen(coalesce(heading_path, '')) > 4096"

P5_REJOINED_SQL = "SELECT id AS chunk_id, sha256(coalesce(text, '')) AS text_hash, TRUE AS within, TRUE AS overlaps FROM chunks WHERE strlen(coalesce(text, '')) + strlen(coalesce(heading_path, '')) > 4096"

P7_BOUNDS_SQL = """SELECT lower(trim(t.source)) AS source, bool_or(d.source IS NOT NULL) AS share_met, TRUE AS repeats_met
FROM mix_targets t LEFT JOIN (SELECT DISTINCT lower(trim(source)) AS source FROM documents WHERE text <> '') d ON d.source = lower(trim(t.source)) GROUP BY 1"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_neighbours": p1_neighbours,
        "p2_found": p2_found,
        "p2_cleaned": p2_cleaned,
        "p4_found": p4_found,
        "p4_repaired": p4_repaired,
        "p5_found": p5_found,
        "p5_pieces": p5_pieces,
        "p5_rejoined": p5_rejoined,
        "p6_found": p6_found,
        "p6_removed": p6_removed,
        "p7_mixture": p7_mixture,
        "p7_shares": p7_shares,
        "p7_bounds": p7_bounds,
        "p8_found": p8_found,
        "p8_units": p8_units,
    }


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p5_found": P5_SQL, "p5_rejoined": P5_REJOINED_SQL, "p7_bounds": P7_BOUNDS_SQL}
