"""Queries on retrieval metrics, evaluation sets, text and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellumine.functions.chunking import chunk_texts
from vellumine.functions.embedding import compose_passage, compose_query, too_long
from vellumine.functions.text import normalize_bytes, preview, strip_control
from vellumine.operators import evaluate, quality
from vellumine.runtime import table
from vellumine.streaming.debounce import debounce_batch

DENIED = ["direct debit", "Pension-Letter", "roof vent"]
TEMPLATE = "title: {t} | text: {d}"
DAY_US = 6 * 3600 * 1_000_000


def _ranked(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    """A deterministic ranking for every golden query: its judged paths and the catalog's of the same length."""
    g, f = table(spark, sf_dir, "golden_queries"), table(spark, sf_dir, "catalog_files")
    judged = g.select("id", F.explode(F.concat("relevant", "acceptable")).alias("path"))
    noise = g.select("id", (F.length("query") % 25 + 25).alias("n")).join(f.select("path", F.length("path").alias("n")), "n").select("id", "path")
    every = judged.unionByName(noise).distinct()
    d = (F.length("path") * 37 + F.ascii(F.substring("path", -5, 1)) * 11 + F.expr("cast(substring(id, 2, 3) as int)") * shift) % 101
    return every.select("id", "path", (d / 101.0).alias("distance"))


def golden_score_per_query(spark, sf_dir) -> DataFrame:
    s = evaluate.score_queries(table(spark, sf_dir, "golden_queries"), _ranked(spark, sf_dir, 7))
    return s.select("id", "n_relevant", F.round("recall", 6).alias("recall"), F.round("rr", 6).alias("rr"), "success", "acceptable")


def slice_aggregates(spark, sf_dir) -> DataFrame:
    s = evaluate.slice_stats(evaluate.score_queries(table(spark, sf_dir, "golden_queries"), _ranked(spark, sf_dir, 7)))
    return s.select("slice", "n", F.round("recall", 6).alias("recall"), F.round("rr", 6).alias("rr"), F.round("success", 6).alias("success"), "acceptable")


def paired_comparison(spark, sf_dir) -> DataFrame:
    g = table(spark, sf_dir, "golden_queries")
    a, b = (evaluate.score_queries(g, _ranked(spark, sf_dir, s)) for s in (7, 13))
    return evaluate.compare_runs(a, b).select("slice", "n", "wins", "losses", "ties", *(F.round(c, 6).alias(c) for c in ("mean", "t", "p", "low", "high")))


def win_loss_tie(spark, sf_dir) -> DataFrame:
    return paired_comparison(spark, sf_dir).select("slice", "n", "wins", "losses", "ties", "mean", "t")


def latency_percentiles(spark, sf_dir) -> DataFrame:
    return evaluate.latency(table(spark, sf_dir, "events"), "value", ["event_type"])


def sample_round_robin(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("source is not null").select(F.lower(F.trim("source")).alias("category"), F.col("path").alias("file"))
    return evaluate.sample_round_robin(d, 100)


def trigram_echo(spark, sf_dir) -> DataFrame:
    return quality.echoes(table(spark, sf_dir, "eval_passages"), table(spark, sf_dir, "documents"), "text", "text", "item_id", "doc_id")


def novel_term_rate(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "eval_passages").select("query_id", "text")
    j = table(spark, sf_dir, "golden_queries").join(p, F.col("id") == F.col("query_id"))
    return j.select("id", F.round(quality.novel_rate(F.col("query"), F.col("text")), 6).alias("rate"))


def denylist_hits(spark, sf_dir) -> DataFrame:
    return quality.denied_lines(table(spark, sf_dir, "documents"), DENIED)


def golden_rules(spark, sf_dir) -> DataFrame:
    """The judged paths as relative ones, save those of one folder, which stay absolute and so lie outside."""
    local = lambda c: F.when(c.startswith("/vault/") & ~c.startswith("/vault/tax/"), F.concat(F.lit("corpus/"), F.substring(c, 8, 1 << 20))).otherwise(c)
    g = table(spark, sf_dir, "golden_queries")
    g = g.withColumn("relevant", F.transform("relevant", local)).withColumn("acceptable", F.transform("acceptable", local))
    texts = table(spark, sf_dir, "chunks").select("content_hash", "text")
    docs = table(spark, sf_dir, "catalog_files").select(local(F.col("path")).alias("path"), "content_hash").join(texts, "content_hash", "left").select("path", "text")
    return quality.golden_violations(g, docs).distinct()


def compose_passages(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "chunks")
    p = compose_passage(F.col("text"), F.col("heading_path"), TEMPLATE)
    return c.select("id", F.sha2(p, 256).alias("passage_hash"), F.octet_length(p).cast("long").alias("bytes"), too_long(p, 512).alias("too_long"))


def compose_queries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "golden_queries").select("id", compose_query(F.col("query"), "query: {q}").alias("composed"))


def text_previews(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", preview(F.col("text"), 80).alias("preview"), F.length(strip_control(F.col("text"))).cast("long").alias("printable"))


def chunk_documents(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("content_hash", "text").dropDuplicates(["content_hash"])
    return chunk_texts(d).select("content_hash", "ordinal", "heading_path", "byte_start", "byte_end", "text")


def chunk_with_ceiling(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("content_hash", "text").dropDuplicates(["content_hash"])
    return chunk_texts(d, ceiling_tokens=128).select("content_hash", "ordinal", "heading_path", "byte_start", "byte_end", "warning")


def chunk_spans(spark, sf_dir) -> DataFrame:
    """Of every chunked content: whether its chunks are the bytes their spans name, are numbered from 0 without gaps, do not go back, and leave out no letter but those of headings."""
    d = table(spark, sf_dir, "documents").select("content_hash", "text").dropDuplicates(["content_hash"])
    c = chunk_texts(d).join(d.select("content_hash", F.col("text").cast("binary").alias("raw")), "content_hash")
    span = F.substring("raw", (F.col("byte_start") + 1).cast("int"), (F.col("byte_end") - F.col("byte_start")).cast("int"))
    w = Window.partitionBy("content_hash").orderBy("ordinal")
    c = c.withColumn("fine", (span == F.col("text").cast("binary")) & (F.row_number().over(w) - 1 == F.col("ordinal")) & (F.col("byte_start") >= F.coalesce(F.lag("byte_start").over(w), F.lit(0))))
    return c.groupBy("content_hash").agg(F.min("fine").alias("fine"), (F.max("byte_end") <= F.max(F.octet_length("raw"))).alias("inside"))


def normalize_encodings(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, F.encode("text", "UTF-8")).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).when(k == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).otherwise(F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")))
    out = normalize_bytes(d.select("doc_id", raw.alias("raw")))
    return out.select("doc_id", F.sha2("text", 256).alias("text_hash"), "error")


def debounce_windows(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return debounce_batch(e, "user_id", "t", DAY_US)


QUERIES = {
    f.__name__: f
    for f in (
        golden_score_per_query, slice_aggregates, paired_comparison, win_loss_tie, latency_percentiles, sample_round_robin, trigram_echo, novel_term_rate, denylist_hits,
        golden_rules, compose_passages, compose_queries, text_previews, chunk_documents, chunk_with_ceiling, chunk_spans, normalize_encodings, debounce_windows,
    )
}


def _scores(shift: int, name: str) -> str:
    return f"""r{name} AS (SELECT id, path, ((length(path) * 37 + ascii(path[-5:-5]) * 11 + CAST(id[2:4] AS INT) * {shift}) % 101) / 101.0::DOUBLE AS d FROM every),
w{name} AS (SELECT r.id, r.path, m.j, row_number() OVER (PARTITION BY r.id ORDER BY d, r.path) AS place,
  row_number() OVER (PARTITION BY r.id ORDER BY d, r.path) - sum(CASE WHEN m.j = 'a' THEN 1 ELSE 0 END) OVER (PARTITION BY r.id ORDER BY d, r.path) AS rank
  FROM r{name} r LEFT JOIN marks m ON m.id = r.id AND m.path = r.path),
t{name} AS (SELECT id, count(*) FILTER (j = 'r' AND rank <= 10) AS hits, min(rank) FILTER (j = 'r' AND rank <= 10) AS first, count(*) FILTER (j = 'a' AND place <= 10) AS acc FROM w{name} GROUP BY id),
s{name} AS (SELECT g.id, g.tags, len(list_distinct(g.relevant)) AS n_relevant,
  CASE WHEN len(g.relevant) > 0 THEN coalesce(hits, 0)::DOUBLE / len(list_distinct(g.relevant)) ELSE 0.0::DOUBLE END AS recall,
  CASE WHEN len(g.relevant) > 0 THEN coalesce(1.0::DOUBLE / first, 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS rr,
  CASE WHEN len(g.relevant) > 0 AND first = 1 THEN 1::BIGINT ELSE 0::BIGINT END AS success, CASE WHEN len(g.relevant) > 0 THEN coalesce(acc, 0) ELSE 0::BIGINT END AS acceptable
  FROM golden_queries g LEFT JOIN t{name} t ON t.id = g.id)"""


_RANKED = """WITH judged AS (SELECT id, unnest(relevant) AS path, 'r' AS j FROM golden_queries UNION SELECT id, unnest(acceptable), 'a' FROM golden_queries),
marks AS (SELECT id, path, max(j) AS j FROM judged GROUP BY ALL),
every AS (SELECT id, path FROM judged UNION SELECT g.id, f.path FROM golden_queries g JOIN catalog_files f ON length(f.path) = length(g.query) % 25 + 25),
"""
_SLICES = "unnest(list_concat(['overall'], CASE WHEN NOT list_contains(tags, 'exact') THEN ['no_exact'] ELSE []::VARCHAR[] END, list_transform(list_distinct(tags), lambda x: 'tag:' || x))) AS slice"
# Fixed values, written out so that the SQL does not depend on the operator's.
_STOP = (
    "'a', 'an', 'and', 'are', 'as', 'at', 'be', 'but', 'by', 'did', 'do', 'does', 'for', 'from', 'had', 'has', 'have', 'how', 'i', 'in', 'is', 'it', 'its', 'me', 'much', 'my', 'of', 'on', 'or', "
    "'our', 'so', 'that', 'the', 'their', 'them', 'they', 'this', 'to', 'up', 'was', 'we', 'were', 'what', 'when', 'where', 'which', 'who', 'why', 'will', 'with', 'you', 'your'"
)
_TERMS = lambda c: rf"list_filter(list_transform(regexp_split_to_array(lower({c}), '\s+'), lambda x: regexp_replace(x, '[^\p{{L}}\p{{N}}]', '', 'g')), lambda x: x <> '' AND x NOT IN ({_STOP}))"
_GRAMS = lambda c: f"(SELECT CASE WHEN len(t) >= 3 THEN list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) ELSE [] END FROM (SELECT {c} AS t))"
def _t_half(x: str, v: str) -> str:
    """The share of Student's distribution between 0 and ``x``: Simpson's rule over the angle atan(x / sqrt(v)), where the density is a power of the cosine."""
    w = f"list_sum(list_transform(range(0, 401), lambda i: (CASE WHEN i % 400 = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(atan(({x}) / sqrt({v})) * i / 400.0), {v} - 1)))"
    return f"(exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2)) / sqrt(pi()) * atan(({x}) / sqrt({v})) / 1200.0 * {w})"


_LOCAL = lambda c: f"list_transform({c}, lambda x: CASE WHEN starts_with(x, '/vault/') AND NOT starts_with(x, '/vault/tax/') THEN 'corpus/' || x[8:] ELSE x END)"

SQL = {
    "golden_score_per_query": _RANKED + _scores(7, "a") + " SELECT id, n_relevant, round(recall, 6) AS recall, round(rr, 6) AS rr, success, acceptable FROM sa",
    "slice_aggregates": _RANKED
    + _scores(7, "a")
    + f""" SELECT slice, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS rr, round(avg(success), 6) AS success, sum(acceptable)::BIGINT AS acceptable
FROM (SELECT *, {_SLICES} FROM sa WHERE n_relevant > 0 AND NOT list_contains(tags, 'zero-answer')) GROUP BY slice""",
    "win_loss_tie": _RANKED
    + _scores(7, "a")
    + ", "
    + _scores(13, "b")
    + f""", d AS (SELECT sa.id, sa.tags, sb.rr - sa.rr AS delta FROM sa JOIN sb ON sb.id = sa.id WHERE sa.n_relevant > 0)
SELECT slice, count(*) AS n, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta < 0) AS losses, count(*) FILTER (delta = 0) AS ties, round(avg(delta), 6) AS mean,
CASE WHEN count(*) = 1 OR (min(delta) = max(delta) AND avg(delta) = 0) THEN 0.0::DOUBLE WHEN min(delta) = max(delta) THEN sign(avg(delta)) * 'inf'::DOUBLE
ELSE round(avg(delta) / (stddev_samp(delta) / sqrt(count(*))), 6) END AS t FROM (SELECT *, {_SLICES} FROM d) GROUP BY slice""",
    "paired_comparison": _RANKED
    + _scores(7, "a")
    + ", "
    + _scores(13, "b")
    + f""", d AS (SELECT sa.id, sa.tags, sb.rr - sa.rr AS delta FROM sa JOIN sb ON sb.id = sa.id WHERE sa.n_relevant > 0),
g AS (SELECT slice, count(*) AS n, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta < 0) AS losses, count(*) FILTER (delta = 0) AS ties, avg(delta) AS m,
  stddev_samp(delta) / sqrt(count(*)) AS e, count(*) > 1 AND min(delta) <> max(delta) AS real, count(*) > 1 AND min(delta) = max(delta) AND avg(delta) <> 0 AS flat FROM (SELECT *, {_SLICES} FROM d) GROUP BY slice),
q AS MATERIALIZED (SELECT *, CASE WHEN real THEN m / e WHEN flat THEN sign(m) * 'inf'::DOUBLE ELSE 0.0::DOUBLE END AS t, (n - 1)::DOUBLE AS v FROM g),
b AS (WITH RECURSIVE s AS (SELECT slice, v, 0.0::DOUBLE AS lo, 1000.0::DOUBLE AS hi, 0 AS k FROM q WHERE real
  UNION ALL SELECT slice, v, CASE WHEN {_t_half("(lo + hi) / 2", "v")} < 0.475 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_t_half("(lo + hi) / 2", "v")} < 0.475 THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM s WHERE k < 50)
  SELECT slice, (lo + hi) / 2 AS c FROM s WHERE k = 50)
SELECT q.slice, n, wins, losses, ties, round(m, 6) AS mean, round(t, 6) AS t, round(CASE WHEN real THEN 1 - 2 * {_t_half("abs(t)", "v")} WHEN flat THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END, 6) AS p,
round(CASE WHEN real THEN m - c * e ELSE m END, 6) AS low, round(CASE WHEN real THEN m + c * e ELSE m END, 6) AS high FROM q LEFT JOIN b ON b.slice = q.slice""",
    "text_previews": r"""SELECT doc_id, CASE WHEN length(f) <= 80 THEN f ELSE rtrim(substring(f, 1, 80)) || '…' END AS preview, printable FROM (
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[\t\n\x0B\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), '[\x00-\x1f\x7f-\x{9f}]', '', 'g'), ' {2,}', ' ', 'g')) AS f,
length(regexp_replace(text, '[\x00-\x1f\x7f-\x{9f}]', '', 'g')) AS printable FROM documents)""",
    "chunk_spans": "SELECT DISTINCT content_hash, TRUE AS fine, TRUE AS inside FROM documents WHERE regexp_matches(text, '\\S')",
    "latency_percentiles": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type",
    "sample_round_robin": """SELECT category, file, turn FROM (SELECT lower(trim(source)) AS category, path AS file, row_number() OVER (PARTITION BY lower(trim(source)) ORDER BY path) AS turn
FROM documents WHERE source IS NOT NULL) ORDER BY turn, category, file LIMIT 100""",
    "trigram_echo": f"""WITH q AS (SELECT item_id, unnest({_GRAMS(_TERMS("text"))}) AS g FROM eval_passages), d AS (SELECT doc_id, unnest({_GRAMS(_TERMS("text"))}) AS g FROM documents)
SELECT item_id, doc_id, count(*) AS n_shared FROM q JOIN d ON d.g = q.g GROUP BY 1, 2""",
    "novel_term_rate": f"""WITH j AS (SELECT g.id, list_distinct({_TERMS("g.query")}) AS q, {_TERMS("p.text")} AS d FROM golden_queries g JOIN eval_passages p ON p.query_id = g.id)
SELECT id, round(CASE WHEN len(q) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(q, lambda x: NOT list_contains(d, x)))::DOUBLE / len(q) END, 6) AS rate FROM j""",
    "denylist_hits": r"""WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS ls FROM documents),
n AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS t FROM l), e AS (SELECT unnest(['direct debit', 'Pension-Letter', 'roof vent']) AS entry)
SELECT doc_id, entry, line FROM n, e WHERE contains(regexp_replace(lower(t), '[^\p{L}\p{N}]', '', 'g'), regexp_replace(lower(entry), '[^\p{L}\p{N}]', '', 'g'))""",
    "golden_rules": f"""WITH q AS (SELECT id, query, tags, {_LOCAL('relevant')} AS relevant, {_LOCAL('acceptable')} AS acceptable FROM golden_queries),
p AS (SELECT id, query, tags, unnest(list_concat(relevant, acceptable)) AS path FROM q),
f AS (SELECT CASE WHEN starts_with(path, '/vault/') AND NOT starts_with(path, '/vault/tax/') THEN 'corpus/' || path[8:] ELSE path END AS path, content_hash FROM catalog_files),
t AS (SELECT DISTINCT f.path, unnest({_GRAMS(_TERMS("c.text"))}) AS g FROM f JOIN chunks c ON c.content_hash = f.content_hash WHERE f.path IN (SELECT path FROM p)),
w AS (SELECT id, path, unnest({_GRAMS(_TERMS("query"))}) AS g FROM p WHERE NOT list_contains(tags, 'exact') AND NOT list_contains(tags, 'human') AND starts_with(path, 'corpus/'))
SELECT DISTINCT id, rule FROM (
SELECT id, 'blank_query' AS rule FROM q WHERE trim(coalesce(query, '')) = ''
UNION ALL SELECT id, 'register' FROM q WHERE len(list_intersect(tags, ['kw', 'nl', 'recall', 'exact'])) <> 1
UNION ALL SELECT id, 'answers' FROM q WHERE list_contains(tags, 'zero-answer') AND len(relevant) > 0
UNION ALL SELECT id, 'repeated_path' FROM q WHERE len(list_distinct(relevant)) <> len(relevant) OR len(list_distinct(acceptable)) <> len(acceptable)
UNION ALL SELECT id, 'overlap' FROM q WHERE list_has_any(relevant, acceptable)
UNION ALL SELECT id, 'repeated_id' FROM q GROUP BY id HAVING count(*) > 1
UNION ALL SELECT id, 'outside' FROM p WHERE NOT starts_with(path, 'corpus/')
UNION ALL SELECT id, 'unknown_path' FROM p WHERE starts_with(path, 'corpus/') AND path NOT IN (SELECT path FROM f)
UNION ALL SELECT w.id, 'echo' FROM w JOIN t ON t.path = w.path AND t.g = w.g)""",
    "compose_passages": """SELECT id, sha256(p) AS passage_hash, strlen(p) AS bytes, strlen(p) > 2048 AS too_long FROM (SELECT id, 'title: ' || CASE WHEN coalesce(heading_path, '') = '' THEN 'none' ELSE heading_path END || ' | text: ' || text AS p FROM chunks)""",
    "compose_queries": "SELECT id, 'query: ' || query AS composed FROM golden_queries",
    "normalize_encodings": "SELECT doc_id, sha256(text) AS text_hash, NULL::VARCHAR AS error FROM documents",
    "debounce_windows": f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, count(*) AS c FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
w AS (SELECT user_id, min(t) AS s FROM e GROUP BY user_id
  UNION ALL SELECT w.user_id, (SELECT min(t) FROM e WHERE e.user_id = w.user_id AND e.t >= w.s + {DAY_US}) FROM w WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = w.user_id AND e.t >= w.s + {DAY_US}))
SELECT w.user_id, w.s AS window_start, max(e.t) AS last_event, sum(e.c)::BIGINT AS n_events FROM w JOIN e ON e.user_id = w.user_id AND e.t >= w.s AND e.t < w.s + {DAY_US} GROUP BY 1, 2""",
}
