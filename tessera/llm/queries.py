"""One query per operator over its whole table, and the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import contamination
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.labelled import remainder
from tessera.llm.language_id import language_id
from tessera.llm.lm_scores import lm_scores
from tessera.llm.minhash import near_dedup
from tessera.llm.mixing import mix_plan
from tessera.llm.passages import repeated_passages
from tessera.llm.quality import quality
from tessera.llm.token_counts import token_counts
from tessera.llm.shared import small_batches
from tessera.llm.toxicity import toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
      FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS win
       FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
o AS (SELECT dw.doc_id, dw.i, dw.m, p.item_id FROM dw JOIN p ON dw.m = p.m AND dw.win = p.win),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS k FROM (SELECT DISTINCT doc_id, i, m FROM o)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(_read(spark, sf_dir, "documents"), keep="max")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP5_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents),
g AS (SELECT n, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.n) AS text_sha256
FROM t JOIN g ON t.n = g.n
"""

def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _op6_sql(rounds: int = 3) -> str:
    steps, takes = "", []
    for k in range(1, rounds + 1):
        left, last = (f"r{k - 1}.budget", f"r{k - 1}.last") if k > 1 else ("g.budget", "''")
        before = f"JOIN r{k - 1} ON r{k - 1}.source IS NOT DISTINCT FROM d.source" if k > 1 else "JOIN g ON g.source IS NOT DISTINCT FROM d.source"
        steps += f""",
c{k} AS (SELECT d.source, d.key, {left} AS budget, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
       FROM d {before} WHERE d.size > 0 AND d.size <= {left} AND d.key > {last}),
r{k} AS (SELECT b.source, b.budget - coalesce(f.words, 0) AS budget, b.budget AS most, coalesce(f.key, CASE WHEN x.n IS NULL THEN 'g' ELSE b.last END) AS last
       FROM (SELECT source, budget, {"last" if k > 1 else "'' AS last"} FROM {f"r{k - 1}" if k > 1 else "g"}) b
       LEFT JOIN (SELECT source, max(key) AS key, max(run) AS words FROM c{k} WHERE run <= budget GROUP BY source) f ON f.source IS NOT DISTINCT FROM b.source
       LEFT JOIN (SELECT source, count(*) AS n FROM c{k} GROUP BY source) x ON x.source IS NOT DISTINCT FROM b.source)"""
        takes.append(f"(d.key <= r{k}.last AND d.size <= r{k}.most)")
    joins = " ".join(f"JOIN r{k} ON r{k}.source IS NOT DISTINCT FROM d.source" for k in range(1, rounds + 1))
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                  md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS ss FROM d GROUP BY source),
w AS (SELECT source, ss, 3 * ss AS cap, CAST(1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS HUGEINT) AS w FROM s),
o AS (SELECT *, sum(ss) OVER () - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
             sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS among FROM w),
k AS (SELECT *, cap * among < w * lft AS clamped FROM o),
f AS (SELECT *, sum(ss) OVER () - sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER () AS rest, sum(CASE WHEN clamped THEN 0 ELSE w END) OVER () AS free FROM k),
t AS (SELECT source, ss, CASE WHEN ss = 0 THEN 0 WHEN clamped THEN CAST(cap AS DOUBLE) ELSE CAST(w * rest AS DOUBLE) / CAST(free AS DOUBLE) END AS target FROM f),
g AS (SELECT *, CASE WHEN ss = 0 THEN 0 ELSE least(floor(target / CAST(ss AS DOUBLE)), 3) END AS whole,
             target - (CASE WHEN ss = 0 THEN 0 ELSE least(floor(target / CAST(ss AS DOUBLE)), 3) END) * CAST(ss AS DOUBLE) AS budget FROM t){steps}
SELECT d.doc_id, d.size, CAST(g.ss AS BIGINT) AS source_size, g.target,
       CAST(d.size * (CASE WHEN d.size = 0 THEN 0 ELSE g.whole + CASE WHEN {" OR ".join(takes)} THEN 1 ELSE 0 END END) AS BIGINT) AS taken
FROM d JOIN g ON g.source IS NOT DISTINCT FROM d.source {joins}
"""


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), allowed=remainder("doc_id", 4) != 2)
    return found.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_read(spark, sf_dir, "documents"), shingle=3, percent=85)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_read(spark, sf_dir, "documents")).withColumn("log_score", F.round("log_score", 4))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents),
p AS (SELECT r, i, w[i] AS w, CASE WHEN i > 1 THEN w[i - 1] END AS v, CASE WHEN i > 2 THEN w[i - 2] END AS u FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM d)),
g1 AS (SELECT w, count(*) AS n FROM p GROUP BY w),
g2 AS (SELECT v, w, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY v, w HAVING count(*) >= 2),
g3 AS (SELECT u, v, w, count(*) AS n FROM p WHERE u IS NOT NULL GROUP BY u, v, w HAVING count(*) >= 2),
t AS (SELECT sum(n) AS n FROM g1),
s AS (SELECT p.r, CASE WHEN p.u IS NOT NULL THEN g3.n IS NULL ELSE p.v IS NOT NULL AND g2.n IS NULL END AS missed,
             CASE WHEN g3.n IS NOT NULL THEN ln(g3.n / c2.n)
                  ELSE CASE WHEN p.u IS NULL THEN 0 ELSE ln(0.4) END + CASE WHEN p.v IS NULL THEN ln(g1.n / t.n) WHEN g2.n IS NULL THEN ln(0.4) + ln(g1.n / t.n) ELSE ln(g2.n / c1.n) END END AS score
      FROM p JOIN g1 ON g1.w = p.w CROSS JOIN t LEFT JOIN g2 ON g2.v = p.v AND g2.w = p.w LEFT JOIN g1 c1 ON c1.w = p.v
      LEFT JOIN g3 ON g3.u = p.u AND g3.v = p.v AND g3.w = p.w LEFT JOIN g2 c2 ON c2.v = p.u AND c2.w = p.v)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(sum(CASE WHEN s.missed THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_backoff, coalesce(round(sum(s.score), 4), 0) AS log_score
FROM d LEFT JOIN s ON s.r = d.r GROUP BY d.r, d.doc_id, d.w
"""


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id(_read(spark, sf_dir, "documents"), allowed=remainder("doc_id", 5) != 0)
    return found.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_read(spark, sf_dir, "documents"))


QUERIES = {"op10_passages": op10_passages, "op7_token_counts": op7_token_counts, "op9_lm_scores": op9_lm_scores, "op1_quality": op1_quality, "op8_language_id": op8_language_id, "op2_toxicity": op2_toxicity, "op3_minhash": op3_minhash, "op6_mixing": op6_mixing, "op4_decontaminate": op4_decontaminate, "op5_exact_dedup": op5_exact_dedup}
ORACLES = {"op9_lm_scores": OP9_SQL, "op6_mixing": _op6_sql(), "op4_decontaminate": OP4_SQL, "op5_exact_dedup": OP5_SQL}
