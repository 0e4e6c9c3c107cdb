"""Dictionaries: DataFrames unique on term, with a nullable value for maps.

Every method is a lazy transformation; a Dictionary never changes, a mutation gives a new one. A member
without a value has a NULL value and stays a member; '' is a term as any other. Row order is no part of
a result unless a docstring says so.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import units

#: Prefix lists up to this many are turned into a filter that the scan can use; longer ones into a join.
FILTER_PREFIXES = 64
BROADCAST_ROWS = 200_000


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@dataclass(frozen=True)
class Dictionary:
    df: DataFrame
    unit: str = "char"

    # --- building (IO-01 to IO-04, IO-06, IO-07)

    @classmethod
    def from_terms(cls, df: DataFrame, term: str = "term", unit: str = "char") -> "Dictionary":
        return cls(df.select(F.col(term).alias("term")).where("term IS NOT NULL").distinct(), units.check(unit))

    from_sorted_terms = from_terms

    @classmethod
    def from_terms_with_values(cls, df: DataFrame, term: str = "term", value: str = "value", ordinal: str = "ordinal", unit: str = "char") -> "Dictionary":
        """The value with the greatest ordinal wins, as parquet rows have no order of their own."""
        out = df.where(F.col(term).isNotNull()).groupBy(F.col(term).alias("term")).agg(F.max_by(F.struct(F.col(value).alias("v")), ordinal).alias("s"))
        return cls(out.select("term", F.col("s.v").alias("value")), units.check(unit))

    from_sorted_terms_with_values = from_terms_with_values

    @classmethod
    def empty(cls, like: DataFrame, unit: str = "char") -> "Dictionary":
        return cls(like.limit(0), units.check(unit))

    @property
    def valued(self) -> bool:
        return "value" in self.df.columns

    @property
    def is_suffix_based(self) -> bool:
        return False

    def _with(self, df: DataFrame) -> "Dictionary":
        return replace(self, df=df)

    def valued_members(self) -> "Dictionary":
        """Members that have a value (the valued dump, IO-17)."""
        return self._with(self.df.where("value IS NOT NULL"))

    def with_default(self, default) -> "Dictionary":
        return self._with(self.df.withColumn("value", F.coalesce("value", F.lit(default))))

    # --- lookup (F-01 to F-05, F-09)

    def contains(self, probes: DataFrame) -> DataFrame:
        """probes (unique or not) with a boolean found."""
        marked = self.df.select("term", F.lit(True).alias("_hit"))
        return probes.join(marked, "term", "left").withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")

    def members(self, probes: DataFrame) -> DataFrame:
        return probes.join(self.df.select("term"), "term", "left_semi")

    def get_value(self, probes: DataFrame) -> DataFrame:
        return probes.join(self.df.select("term", "value"), "term", "left")

    def contains_with_value(self, probes: DataFrame, test: Callable[[Column], Column]) -> DataFrame:
        return probes.join(self.df.where(test(F.col("value"))).select("term"), "term", "left_semi")

    def matches_any(self, test: Callable[[Column], Column]) -> Column:
        """Whether an atom of the value passes: elements of an array, else the value itself."""
        return F.coalesce(F.exists("value", test) if self._is_array else test(F.col("value")), F.lit(False))

    def matches_all(self, test: Callable[[Column], Column]) -> Column:
        return F.coalesce(F.forall("value", test) if self._is_array else test(F.col("value")), F.lit(False))

    @property
    def _is_array(self) -> bool:
        return self.df.schema["value"].dataType.typeName() == "array"

    def size(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("n_terms"))

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    # --- prefixes (P-01 to P-10)

    def with_prefix(self, prefix) -> "Dictionary":
        return self._with(self.df.where(units.starts_with(F.col("term"), prefix, self.unit)))

    def excluding(self, *prefixes) -> "Dictionary":
        """Without the terms under any of the prefixes; an empty prefix leaves nothing."""
        tests = [units.starts_with(F.col("term"), p, self.unit) for p in prefixes]
        return self._with(self.df.where(~reduce(Column.__or__, tests))) if tests else self

    def with_any_prefix(self, prefixes: DataFrame, how: str = "left_semi") -> "Dictionary":
        """Terms under any prefix of a table (prefix): an equi-join on the heads of the lengths that occur."""
        lengths = [r[0] for r in prefixes.where("prefix IS NOT NULL").select(units.length(F.col("prefix"), self.unit).alias("n")).distinct().orderBy("n").collect()]
        if not lengths:
            return self if how == "left_anti" else self._with(self.df.limit(0))
        size = units.length(F.col("term"), self.unit)
        heads = F.filter(F.array(*[F.when(size >= n, units.slice_of(F.col("term"), 0, n, self.unit)) for n in lengths]), lambda h: h.isNotNull())
        own = F.col("prefix").cast("binary") if self.unit == "byte" else F.col("prefix")
        hit = self.df.select("term", F.explode(heads).alias("prefix")).join(checked_broadcast(prefixes.select(own.alias("prefix")).distinct()), "prefix", "left_semi").select("term").distinct()
        return self._with(self.df.join(hit, "term", how))

    def excluding_any(self, prefixes: DataFrame) -> "Dictionary":
        return self.with_any_prefix(prefixes, "left_anti")

    def key(self, value) -> Column:
        """A literal of the terms' type: a string, or a list of numbers for the unit u64."""
        return F.lit(value).cast(self.df.schema["term"].dataType)

    def page_after(self, cursor, limit: int, prefix=None) -> DataFrame:
        """The next limit terms in byte order (number by number for u64) after the cursor."""
        out = self.with_prefix(self.key(prefix)).df if prefix else self.df
        if cursor is not None:
            out = out.where(F.col("term") > self.key(cursor))
        return out.orderBy("term").limit(limit)

    def children(self, prefix) -> DataFrame:
        """label, is_final of the units that can follow the prefix."""
        n = len(prefix.encode() if self.unit == "byte" and isinstance(prefix, str) else prefix)
        size = units.length(F.col("term"), self.unit)
        below = self.with_prefix(self.key(prefix)).df.where(size > n)
        return below.groupBy(units.slice_of(F.col("term"), n, 1, self.unit).alias("label")).agg(F.bool_or(size == n + 1).alias("is_final"))

    # --- mutation (M-01 to M-07, M-13)

    def insert(self, other: DataFrame) -> "Dictionary":
        """Union of members; values of present members stay."""
        if not self.valued:
            return self._with(self.df.union(other.select("term")).distinct())
        both = self.df.join(other.select("term").distinct(), "term", "full_outer")
        return self._with(both.select("term", "value"))

    def new_terms(self, other: DataFrame) -> DataFrame:
        return other.select("term").distinct().join(self.df, "term", "left_anti")

    def upsert(self, other: DataFrame) -> "Dictionary":
        """other's (term, value) win, NULL values included."""
        return self.merge(other, lambda old, new: new)

    def merge(self, other: DataFrame, both: Callable[[Column, Column], Column], skip_null: bool = False) -> "Dictionary":
        """Full outer join; where a term is in both, both(old, new) is the value.

        skip_null: a right member without a value leaves the left one as it is (and adds none).
        """
        right = other.select("term", F.struct(F.col("value").alias("v")).alias("_new"))
        if skip_null:
            right = right.where("_new.v IS NOT NULL")
        joined = self.df.select("term", F.struct(F.col("value").alias("v")).alias("_old")).join(right, "term", "full_outer")
        value = F.when(F.col("_new").isNull(), F.col("_old.v")).when(F.col("_old").isNull(), F.col("_new.v")).otherwise(both(F.col("_old.v"), F.col("_new.v")))
        return self._with(joined.select("term", value.alias("value")))

    def remove(self, terms: DataFrame) -> "Dictionary":
        return self._with(self.df.join(terms.select("term").distinct(), "term", "left_anti"))

    def remove_prefix(self, prefix) -> "Dictionary":
        return self.excluding(prefix)

    def update_or_insert(self, keys: DataFrame, default, update: Callable[[Column], Column], update_default: bool = False) -> "Dictionary":
        """update(value) where a key is present; else the default, as it is or updated as well."""
        first = update(F.lit(default)) if update_default else F.lit(default)
        right = keys.select("term").distinct().withColumn("_key", F.lit(True))
        joined = self.df.withColumn("_own", F.lit(True)).join(right, "term", "full_outer")
        value = F.when(F.col("_own").isNull(), first).when(F.col("_key"), update(F.col("value"))).otherwise(F.col("value"))
        return self._with(joined.select("term", value.alias("value")))

    def get_or_insert(self, other: DataFrame) -> "Dictionary":
        return self.merge(other, lambda old, new: F.coalesce(old, new))

    def compare_and_swap(self, changes: DataFrame) -> tuple["Dictionary", DataFrame]:
        """changes: term, expected, value (one per term). The new dictionary and (term, success).

        expected NULL: only an absent term or one without a value is written.
        """
        joined = changes.join(self.df.select("term", F.col("value").alias("_old")), "term", "left")
        joined = joined.withColumn("success", F.col("_old").eqNullSafe(F.col("expected")))
        return self.upsert(joined.where("success").select("term", "value")), joined.select("term", "success")

    def clear(self) -> "Dictionary":
        return self._with(self.df.limit(0))
