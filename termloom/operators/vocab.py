"""Vocabularies (write-once term ids) and bijections (unique terms and unique values)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.sources import shared


def numbered(df: DataFrame, order: list, name: str, start: int = 0, buckets: int | None = None) -> DataFrame:
    """df with dense numbers from start in the given order, without one task that sees all rows.

    Rows are range-partitioned (as many ranges as the session has shuffle partitions, unless told) and numbered
    inside each partition; the partitions' counts (one row each) give the offsets. The ranges are fixed by storing
    them in the shared folder.
    """
    spark = df.sparkSession
    path = shared.fresh(spark, "ranges")
    ranged = df.repartitionByRange(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id())
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    inside = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return inside.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_row") - 1 + F.lit(start)).drop("_part", "_row", "_before")


def assign(vocab: DataFrame | None, terms: DataFrame, start_index: int = 0) -> DataFrame:
    """(term, id): vocab's rows, and new terms (term, first_seen) with the next ids in order of appearance."""
    new = terms.groupBy("term").agg(F.min("first_seen").alias("first_seen"))
    next_index = start_index
    if vocab is not None:
        new = new.join(vocab, "term", "left_anti")
        next_index = vocab.agg(F.coalesce(F.max("id") + 1, F.lit(start_index))).first()[0]
    out = numbered(new, ["first_seen", "term"], "id", next_index).select("term", F.col("id").cast("long").alias("id"))
    return out if vocab is None else vocab.select("term", "id").union(out)


def insert_with_index(vocab: DataFrame, rows: DataFrame, start_index: int = 0) -> DataFrame:
    """rows (term, id) with outcome: inserted, identical, below_start, term_has_other_id or id_taken."""
    own = vocab.select("term", F.col("id").alias("_own"))
    taken = vocab.select(F.col("id"), F.col("term").alias("_owner"))
    out = rows.join(own, "term", "left").join(taken, "id", "left")
    return out.select(
        "term",
        "id",
        F.when(F.col("id") < start_index, "below_start").when(F.col("_own") == F.col("id"), "identical").when(F.col("_own").isNotNull(), "term_has_other_id").when(F.col("_owner").isNotNull(), "id_taken").otherwise("inserted").alias("outcome"),
    )


def index_of(vocab: DataFrame, terms: DataFrame) -> DataFrame:
    return terms.join(vocab, "term", "left")


def term_of(vocab: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(vocab, "id", "left")


def union_with(vocab: DataFrame, other: DataFrame) -> DataFrame:
    """vocab with the terms that only other has, under the next ids in the order of other's ids."""
    return assign(vocab, other.select("term", F.col("id").alias("first_seen")))


def bijection_conflicts(pairs: DataFrame) -> DataFrame:
    """Rows of pairs (term, value) that share a term (looked at first) or a value with another row."""
    def twice(column: str) -> DataFrame:
        return pairs.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(column, F.lit(True).alias(f"_{column}"))

    out = pairs.join(twice("term"), "term", "left").join(twice("value"), "value", "left").where("_term OR _value")
    return out.select("term", "value", F.when(F.col("_term"), "duplicate_term").otherwise("duplicate_value").alias("error"))


def inverse(pairs: DataFrame) -> DataFrame:
    """(value, term): the reverse side of a bijection."""
    return pairs.select("value", "term")
