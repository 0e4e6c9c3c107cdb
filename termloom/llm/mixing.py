"""Operator 7, mixing sources to target weights.

Every document gets a hash-random key. Within a source the keys are range-sorted: equal ranges of the
key are the buckets, so a hot source has as many buckets as its size asks for and no task gets a whole
source. Prefix sums of sizes are distributed: sums of buckets first, then inside each bucket. A source
is taken in whole epochs while its budget lasts, and the last epoch is cut where the budget is used up;
the document at the cut is taken in part (its first words).

Targets: the sources share ratio * all sizes by weight, none more than max_epochs times its size; what
is above is reshared by weight. With sources ordered by size / weight, the capped ones are a prefix, so
one pass of running sums over the table of sources (one row each) finds the level.

Defined cases: a null text has size 0 and is taken 0 times; null is a source of its own, last in order;
repeated rows are documents of their own (equal keys are ordered by doc_id, then size); an empty table
gives an empty result; other columns are carried by mixed_documents() and not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.llm.common import SPACE, stored, table

WEIGHTS = (3, 1, 2)
RATIO = 1.5
MAX_EPOCHS = 2
#: Documents that a bucket of keys holds on average.
BUCKET_ROWS = 50_000


def sized(docs: DataFrame, seed: str) -> DataFrame:
    """doc_id, source, size (words) and the random key (hex digits of an md5)."""
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")).alias("key"),
    )


def targets(sizes: DataFrame, weights=WEIGHTS, ratio: float = RATIO, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source, source_size, n_docs, target."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("_n", F.row_number().over(order) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_n") % len(weights) + 1).cast("int")))
    everything = Window.partitionBy(F.lit(1))
    fill = Window.partitionBy(F.lit(1)).orderBy(F.col("source_size") / F.col("weight"), "_n")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns(
        {
            "_left": F.lit(ratio) * F.sum("source_size").over(everything) - max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "_weights": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    per = per.withColumn("_capped", max_epochs * F.col("source_size") * F.col("_weights") < F.col("weight") * F.col("_left"))
    # the level is that of the first source, in the order of filling, that its cap doesn't hold back
    level = F.min(F.when(~F.col("_capped"), F.struct(F.col("source_size") / F.col("weight"), "_n", "_left", "_weights"))).over(everything)
    per = per.withColumn("_level", level)
    target = F.least(
        (max_epochs * F.col("source_size")).cast("double"),
        F.coalesce(F.col("weight") * F.col("_level._left") / F.col("_level._weights"), F.lit(float("inf"))),
    )
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def mixed(docs: DataFrame, weights=WEIGHTS, ratio: float = RATIO, max_epochs: int = MAX_EPOCHS, seed: str = "mix-1:", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken; one row per document."""
    sizes = stored(sized(docs, seed), "mix-sizes")
    goal = targets(sizes, weights, ratio, max_epochs)
    # sources: one row each, joined by hash or broadcast as their measured size allows
    rows = sizes.join(goal, sizes["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / bucket_rows))
    rows = rows.withColumn("_bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * buckets))
    sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_in_bucket"))
    along = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_in_bucket").over(along), F.lit(0)).alias("_offset"))
    rows = rows.join(sums, rows["source"].eqNullSafe(sums["_s"]) & (rows["_bucket"] == sums["_b"]))
    inside = Window.partitionBy("source", "_bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return rows.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture as documents: a row for each epoch of a document, the one at a cut shortened.

    Columns as in docs; n_chars, where there is one, is that of the text as taken. Rows that are equal
    in doc_id and size share one decision, the largest.
    """
    count = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    plan = mixed(docs).where("taken > 0").groupBy(F.col("doc_id").alias("_id"), F.col("size").alias("_n")).agg(F.max("taken").alias("_taken"))
    out = docs.select(F.struct("*").alias("_row"), "doc_id", "text", count.alias("_size")).where("_size > 0")
    out = out.join(plan, out["doc_id"].eqNullSafe(plan["_id"]) & (out["_size"] == plan["_n"]))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("_taken") / F.col("_size")))))
    words = F.least(F.col("_size"), F.col("_taken") - (F.col("_copy") - 1) * F.col("_size"))
    cut = F.array_join(F.slice(F.split(F.btrim(F.col("text"), F.lit(SPACE)), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"), 1, words.cast("int")), "")
    out = out.withColumn("text", F.when(words == F.col("_size"), F.col("text")).otherwise(cut))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new[c].alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in docs.columns])


SQL = r"""
WITH s AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
             md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM s GROUP BY source),
w AS (SELECT *, CASE n % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM p),
f AS (SELECT *, CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER b, 0) AS rest,
        sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weights
      FROM w WINDOW b AS (ORDER BY source_size / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT rest, weights FROM f WHERE NOT (2 * source_size * weights < weight * rest) ORDER BY source_size / weight, n LIMIT 1),
g AS (SELECT f.source, f.source_size, least(CAST(2 * f.source_size AS DOUBLE), coalesce(f.weight * l.rest / l.weights, CAST('inf' AS DOUBLE))) AS target
      FROM f LEFT JOIN l ON true),
r AS (SELECT s.*, g.source_size, g.target,
        coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM r)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)) AS BIGINT) AS taken FROM e
"""
