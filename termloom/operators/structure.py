"""Tries and minimal automata as tables, and Bloom filters as bit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _prefixes(terms: DataFrame) -> DataFrame:
    """term, i, path: every prefix of every term, the empty one included."""
    rows = terms.select("term", F.explode(F.sequence(F.lit(0), F.char_length("term"))).alias("i"))
    return rows.withColumn("path", F.substring("term", F.lit(1), F.col("i")))


def trie_nodes(terms: DataFrame) -> DataFrame:
    """path, depth, is_final of every distinct prefix."""
    return _prefixes(terms).groupBy("path").agg(F.first("i").alias("depth"), F.bool_or(F.col("i") == F.char_length("term")).alias("is_final"))


def trie_edges(nodes: DataFrame) -> DataFrame:
    """src, label, dst of the trie, from its nodes."""
    n = F.char_length("path")
    return nodes.where(n > 0).select(F.substring("path", F.lit(1), n - 1).alias("src"), F.substring("path", n, F.lit(1)).alias("label"), F.col("path").alias("dst"))


def dawg_states(terms: DataFrame) -> DataFrame:
    """state (digest of the right language), n_paths, is_final, n_suffixes: the minimal automaton's states."""
    rows = _prefixes(terms).select("path", F.substring("term", F.col("i") + 1, F.char_length("term")).alias("suffix"))
    right = rows.groupBy("path").agg(F.array_sort(F.collect_set("suffix")).alias("s"))
    return right.groupBy(F.sha2(F.to_json("s"), 256).alias("state")).agg(F.count(F.lit(1)).alias("n_paths"), F.bool_or(F.array_contains("s", "")).alias("is_final"), F.max(F.size("s")).alias("n_suffixes"))


def counts(terms: DataFrame) -> DataFrame:
    """How many terms, trie nodes (the root included), trie edges, final nodes and the greatest depth."""
    nodes = trie_nodes(terms).agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if("is_final").alias("n_terms"), F.max("depth").alias("depth"))
    return nodes.select("n_terms", "n_nodes", (F.col("n_nodes") - 1).alias("n_edges"), "depth")


def delta_coded(edges: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """value as differences along order within by (the packed graph form); undo with running sums."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(by).orderBy(order)
    return edges.withColumn("step", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def undelta(steps: DataFrame, by: str, order: str, name: str) -> DataFrame:
    from pyspark.sql.window import Window

    return steps.withColumn(name, F.sum("step").over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def bloom_bits(n: int) -> int:
    return (max(10 * n, 64) + 63) // 64 * 64


def bloom_build(terms: DataFrame, bits: int, k: int = 3) -> DataFrame:
    """The set bits of a Bloom filter: bit."""
    return terms.select(F.explode(F.array(*[F.pmod(F.xxhash64("term", F.lit(i)), F.lit(bits)) for i in range(k)])).alias("bit")).distinct()


def bloom_might_contain(filter_bits: DataFrame, probes: DataFrame, bits: int, k: int = 3) -> DataFrame:
    """probes (unique on term) with might_contain; false is always right."""
    wanted = probes.select("term", F.explode(F.array_distinct(F.array(*[F.pmod(F.xxhash64("term", F.lit(i)), F.lit(bits)) for i in range(k)]))).alias("bit"))
    hit = wanted.join(filter_bits.withColumn("_set", F.lit(1)), "bit", "left")
    return hit.groupBy("term").agg((F.count("_set") == F.count(F.lit(1))).alias("might_contain"))
