"""The operation log: records to operations, reconciliation in commit order, watermark and epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: One record of a log; a kind uses the columns it needs.
SCHEMA = "lsn bigint, kind string, term string, value bigint, delta bigint, result bigint, success boolean, data_lsn bigint, generation bigint, checkpoint_lsn bigint, entries array<struct<term:string,value:bigint,delta:bigint>>"


def operations(log: DataFrame) -> DataFrame:
    """lsn, n (place in its record), op (insert, upsert, remove, delta), term, value, delta.

    Increments set their result, batches fan out, failed swaps and control records give nothing.
    """
    batch = F.col("kind").isin("batch_insert", "batch_increment")
    single = F.array(F.struct("term", F.when(F.col("kind") == "increment", F.col("result")).otherwise(F.col("value")).alias("value"), "delta"))
    rows = log.where(F.col("kind").isin("insert", "upsert", "remove", "increment", "batch_insert", "batch_increment") | ((F.col("kind") == "swap") & F.col("success")))
    rows = rows.select("lsn", "kind", F.posexplode(F.when(batch, F.col("entries")).otherwise(single)).alias("n", "e"))
    op = F.when(F.col("kind").isin("upsert", "increment", "swap"), "upsert").when(F.col("kind") == "remove", "remove").when(F.col("kind") == "batch_increment", "delta").otherwise("insert")
    return rows.select("lsn", "n", op.alias("op"), F.col("e.term").alias("term"), F.col("e.value").alias("value"), F.col("e.delta").alias("delta"))


def ranked(log: DataFrame, ops: DataFrame, overlay: bool, checkpoint_lsn: int | None = None) -> DataFrame:
    """ops with their commit generation: from rank records; unranked ones keep their lsn, or go (overlay)."""
    ranks = log.where("kind = 'commit_rank'").groupBy(F.col("data_lsn").alias("lsn")).agg(F.max("generation").alias("generation"))
    out = ops.join(ranks, "lsn", "inner" if overlay else "left").withColumn("generation", F.coalesce("generation", "lsn"))
    return out if checkpoint_lsn is None else out.where(F.col("lsn") > checkpoint_lsn)


def reconcile(ops: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(term, value) after ops (term, op, value, delta, generation, lsn[, n]) in (generation, lsn) order.

    upsert sets, insert adds a member and keeps a present value, remove clears, delta adds to the value
    or to 0. Built from aggregates with map-side combination, so a hot term needs no list of its history:
    what counts is the last upsert or remove, and behind it the first valued insert before any delta, and
    the sum of deltas.
    """
    place = F.struct("generation", "lsn", "n") if "n" in ops.columns else F.struct("generation", "lsn")
    rows = ops.withColumn("_at", place)
    absolute = F.col("op").isin("upsert", "remove")
    last = rows.where(absolute).groupBy("term").agg(F.max(F.struct("_at", "op", "value")).alias("_last"))
    rows = rows.join(last, "term", "left")
    rows = rows.where(F.col("_last").isNull() | (F.col("_at") >= F.col("_last._at")))
    state = rows.groupBy("term").agg(
        F.first("_last").alias("_last"),
        F.count(F.when(~absolute, 1)).alias("_later"),
        F.sum(F.when(F.col("op") == "delta", F.col("delta"))).alias("_sum"),
        F.min_by(F.struct(F.col("value").alias("v")), F.when((F.col("op") == "insert") & F.col("value").isNotNull(), F.col("_at"))).alias("_given"),
        F.min(F.when((F.col("op") == "insert") & F.col("value").isNotNull(), F.col("_at"))).alias("_given_at"),
        F.min(F.when(F.col("op") == "delta", F.col("_at"))).alias("_delta_at"),
    )
    if base is not None:
        old = base.select("term", F.struct(F.col("value").alias("v")).alias("_old"))
        state = state.join(old, "term", "full_outer")
    else:
        state = state.withColumn("_old", F.lit(None).cast("struct<v:bigint>"))
    start = F.when(F.col("_last").isNull(), F.col("_old.v")).when(F.col("_last.op") == "upsert", F.col("_last.value"))
    given = F.when(F.col("_delta_at").isNull() | (F.col("_given_at") < F.col("_delta_at")), F.col("_given.v"))
    start = F.coalesce(start, given)
    value = F.when(F.col("_sum").isNotNull(), F.coalesce(start, F.lit(0)) + F.col("_sum")).otherwise(start)
    alive = F.when(F.col("_last").isNull(), F.col("_old").isNotNull() | (F.coalesce("_later", F.lit(0)) > 0)).otherwise((F.col("_last.op") == "upsert") | (F.col("_later") > 0))
    return state.where(alive).select("term", value.cast("long").alias("value"))


def folded(ops: DataFrame) -> DataFrame:
    """The same result by a fold over each term's ordered history; for short histories and as a check."""
    place = ["generation", "lsn", *(["n"] if "n" in ops.columns else [])]
    history = ops.groupBy("term").agg(F.array_sort(F.collect_list(F.struct(*place, "op", "value", "delta"))).alias("h"))
    empty = F.struct(F.lit(False).alias("alive"), F.lit(None).cast("long").alias("value"))

    def step(s: Column, r: Column) -> Column:
        value = (
            F.when(r["op"] == "remove", F.lit(None).cast("long"))
            .when(r["op"] == "upsert", r["value"])
            .when(r["op"] == "delta", F.coalesce(s["value"], F.lit(0)) + r["delta"])
            .otherwise(F.coalesce(s["value"], r["value"]))
        )
        return F.struct((r["op"] != "remove").alias("alive"), value.cast("long").alias("value"))

    return history.select("term", F.aggregate("h", empty, step).alias("s")).where("s.alive").select("term", F.col("s.value").alias("value"))


def durable_prefix(log: DataFrame, bad: Column) -> DataFrame:
    """Records before the first bad one; its lsn is one number, so the filter reaches the scan."""
    first = log.where(bad).agg(F.min("lsn")).first()[0]
    return log if first is None else log.where(F.col("lsn") < first)


def committed_watermark(committed: DataFrame, first: int = 1) -> DataFrame:
    """One row: watermark, the largest L such that all lsns from first to L are committed (first - 1: none).

    A gap is an lsn whose successor is missing: one self join instead of a global window.
    """
    seen = committed.where(F.col("lsn") >= first).select("lsn").distinct()
    ends = seen.join(seen.select((F.col("lsn") - 1).alias("lsn"), F.lit(True).alias("_next")), "lsn", "left")
    begun = F.bool_or(F.col("lsn") == first)
    end = F.min(F.when(F.col("_next").isNull(), F.col("lsn")))
    return ends.agg(F.when(begun, end).otherwise(F.lit(first - 1)).cast("long").alias("watermark"))


def epochs(log: DataFrame, max_ops: int, retain: int | None = None) -> DataFrame:
    """epoch_id, first_lsn, last_lsn, n_ops: the log cut every max_ops lsns; the last retain epochs if given."""
    out = log.groupBy(F.floor((F.col("lsn") - 1) / max_ops).alias("epoch_id")).agg(F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"), F.count(F.lit(1)).alias("n_ops"))
    return out if retain is None else out.orderBy(F.desc("epoch_id")).limit(retain)
