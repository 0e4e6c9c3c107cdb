"""Counters and document transactions as aggregates, exact in DECIMAL(38,0) and checked for range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOW = {"i64": -(2**63), "u64": 0}
HIGH = {"i64": 2**63 - 1, "u64": 2**64 - 1}
TYPE = {"i64": "bigint", "u64": "decimal(20,0)"}


def in_range(value: Column, kind: str) -> Column:
    return value.between(F.lit(str(LOW[kind])).cast("decimal(38,0)"), F.lit(str(HIGH[kind])).cast("decimal(38,0)"))


def checked(value: Column, kind: str) -> Column:
    """value in the counter's type; a value out of range is an error of the job."""
    stop = F.raise_error(F.concat(F.lit(f"counter out of range of {kind}: "), value.cast("string"))).cast(TYPE[kind])
    return F.when(in_range(value, kind) | value.isNull(), value.cast(TYPE[kind])).otherwise(stop)


def increment(base: DataFrame, deltas: DataFrame, kind: str = "i64") -> DataFrame:
    """term, value after all deltas (term, delta); an absent counter starts at 0. Hot terms combine map-side."""
    sums = deltas.groupBy("term").agg(F.sum(F.col("delta").cast("decimal(38,0)")).alias("_delta"))
    joined = base.select("term", F.col("value").cast("decimal(38,0)").alias("_base")).join(sums, "term", "full_outer")
    total = F.coalesce("_base", F.lit(0)) + F.coalesce("_delta", F.lit(0))
    return joined.select("term", checked(total.cast("decimal(38,0)"), kind).alias("value"))


def fetch_add(log: DataFrame, order: str = "seq", span: int = 1_000_000) -> DataFrame:
    """Each row of log (term, seq, delta) with the counter's value before and after it.

    Running sums in two levels, so that a hot counter's log is spread: sums of stretches of span orders,
    then inside each stretch. order is a number.
    """
    rows = log.withColumn("_stretch", F.floor(F.col(order) / span))
    before = Window.partitionBy("term").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("term", "_stretch").agg(F.sum("delta").alias("_sum"))
    offsets = sums.select("term", "_stretch", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    run = Window.partitionBy("term", "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.col("_before") + F.sum("delta").over(run)
    out = rows.join(offsets, ["term", "_stretch"]).withColumn("value_after", after)
    return out.withColumn("value_before", F.col("value_after") - F.col("delta")).drop("_stretch", "_before")


def commit_transactions(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per document: (doc_id, committed, n_ops), and (term, value) after the committed ones, in commit order.

    ops: doc_id, commit_seq, op ('set' or 'increment'), term, value, delta, ordinal. A document whose net
    increment of any term is negative is rejected whole. A commit applies its sets first, the last of a
    term by ordinal, then its net increments. A later set of a term discards what came before it.
    Rows without a doc_id can't be told from those of a rejected document: where one is rejected their
    verdict is null and they are not committed, else they are, before any set.
    """
    per = ops.groupBy("doc_id", "commit_seq", "term").agg(
        F.max_by("value", F.when(F.col("op") == "set", F.col("ordinal"))).alias("set_value"),
        F.coalesce(F.bool_or(F.col("op") == "set"), F.lit(False)).alias("is_set"),
        F.coalesce(F.sum(F.when(F.col("op") == "increment", F.col("delta"))), F.lit(0)).alias("net"),
        F.count(F.lit(1)).alias("n"),
    )
    verdict = per.groupBy("doc_id").agg((F.min("net") >= 0).alias("committed"), F.sum("n").alias("n_ops"))
    valid = per.join(verdict.where("committed").select("doc_id"), "doc_id", "left_semi")
    if not ops.where("doc_id IS NULL").isEmpty():
        if verdict.where("NOT committed").isEmpty():
            valid = valid.unionByName(per.where("doc_id IS NULL"))
        else:
            verdict = verdict.withColumn("committed", F.when(F.col("doc_id").isNotNull(), F.col("committed")))
    valid = valid.select("term", "commit_seq", "set_value", "is_set", "net")
    last = valid.where("is_set").groupBy("term").agg(F.max("commit_seq").alias("_last"))
    rows = valid.join(last, "term", "left")  # a term that most documents have is split by the skew join
    state = rows.groupBy("term").agg(
        F.max_by("set_value", F.when(F.col("is_set"), F.col("commit_seq"))).alias("_set"),
        F.sum(F.when(F.col("_last").isNull() | (F.col("commit_seq") >= F.col("_last")), F.col("net"))).alias("_net"),
    )
    return verdict, state.select("term", (F.coalesce("_set", F.lit(0)) + F.coalesce("_net", F.lit(0))).alias("value"))
