"""Set algebra between dictionaries over one tagged table (dict_idx, term, value).

An n-ary operation is one shuffle on term and one aggregate, however many dictionaries take part. Values
are merged by a strategy; members without a value take part in membership, not in merging.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Strategy = Callable[[], Column]


def tagged(*dictionaries: DataFrame) -> DataFrame:
    """Dictionaries (term[, value]) under their index, unique on (dict_idx, term)."""
    parts = [d.select(F.lit(i).alias("dict_idx"), "term", *(["value"] if "value" in d.columns else [])) for i, d in enumerate(dictionaries)]
    return reduce(DataFrame.unionByName, parts)


def first_wins() -> Column:
    return F.min_by("value", F.when(F.col("value").isNotNull(), F.col("dict_idx")))


def last_wins() -> Column:
    return F.max_by("value", F.when(F.col("value").isNotNull(), F.col("dict_idx")))


def join_numbers() -> Column:
    return F.max("value")


def meet_numbers() -> Column:
    return F.min("value")


def join_flags() -> Column:
    return F.bool_or("value")


def meet_flags() -> Column:
    return F.bool_and("value")


def join_sets() -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list("value"))))


def meet_sets() -> Column:
    """Intersection of set values; sorted. NULL where there is none."""
    lists = F.collect_list("value")
    return F.array_sort(F.aggregate(F.slice(lists, 2, F.greatest(F.size(lists), F.lit(1))), F.array_distinct(F.get(lists, 0)), F.array_intersect))


def summed() -> Column:
    return F.sum("value")


def folded(merge: Callable[[Column, Column], Column]) -> Strategy:
    """Any merge(existing, new), folded in dictionary order; one term's values meet in a row."""

    def strategy() -> Column:
        ordered = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("dict_idx", "value"))))
        values = F.transform(ordered, lambda s: s["value"])
        return F.aggregate(F.slice(values, 2, F.greatest(F.size(values), F.lit(1))), F.get(values, 0), merge)

    return strategy


def union(tags: DataFrame) -> DataFrame:
    return tags.select("term").distinct()


def union_valued(tags: DataFrame, strategy: Strategy = first_wins) -> DataFrame:
    return tags.where("value IS NOT NULL").groupBy("term").agg(strategy().alias("value"))


def intersection(tags: DataFrame, n: int) -> DataFrame:
    return tags.groupBy("term").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == n).select("term")


def intersection_valued(tags: DataFrame, n: int, strategy: Strategy = meet_numbers) -> DataFrame:
    """Terms of all n dictionaries with the merged value (NULL if none has one)."""
    return tags.groupBy("term").agg(F.count(F.lit(1)).alias("_n"), strategy().alias("value")).where(F.col("_n") == n).select("term", "value")


def difference(left: DataFrame, right: DataFrame | None) -> DataFrame:
    """left's rows whose term right lacks; without a right all of left."""
    return left if right is None else left.join(right.select("term"), "term", "left_anti")


def symmetric_difference(tags: DataFrame) -> DataFrame:
    """Terms of exactly one dictionary: term, value, source_idx."""
    out = tags.groupBy("term").agg(F.count(F.lit(1)).alias("_n"), F.min("dict_idx").alias("source_idx"), F.max("value").alias("value"))
    return out.where("_n = 1").select("term", "value", "source_idx")


def value_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Terms in both, valued in both, with different values."""
    joined = left.select("term", F.col("value").alias("left_value")).join(right.select("term", F.col("value").alias("right_value")), "term")
    return joined.where("left_value != right_value")


def active_dictionaries(tags: DataFrame, prefix: str) -> DataFrame:
    """How many dictionaries have a term under the prefix, of how many there are."""
    return tags.agg(F.count_distinct("dict_idx").alias("dictionaries"), F.count_distinct(F.when(F.startswith("term", F.lit(prefix)), F.col("dict_idx"))).alias("active"))
