"""Dictionaries as files: lines, tab-separated JSON values, JSON rows, Parquet and node/edge graphs.

All writers write one file per partition in parallel; compression is Spark's ("gzip", "zstd", ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators import structure, vocab
from termloom.sources import shared


def write_lines(df: DataFrame, path: str, compression: str = "none") -> None:
    """One term per line (no values). Terms with a line break can't be told apart from two terms: an error."""
    ok = F.when(F.col("term").rlike("[\r\n]"), F.raise_error(F.lit("a term holds a line break")).cast("string")).otherwise(F.col("term"))
    df.where("term IS NOT NULL").select(ok.alias("value")).write.option("compression", compression).text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Empty lines are skipped, so the empty term is lost by this format."""
    return spark.read.text(path).where("value != ''").select(F.col("value").alias("term"))


def write_tsv(df: DataFrame, path: str, compression: str = "none") -> None:
    """term, a tab, the value as JSON; members without a value are left out."""
    value = F.to_json(F.struct(F.col("value").alias("v")))
    df.where("value IS NOT NULL").select(F.concat("term", F.lit("\t"), F.substring(value, F.lit(6), F.char_length(value) - 6)).alias("value")).write.option("compression", compression).text(path)


def read_tsv(spark: SparkSession, path: str, value_type: str = "bigint") -> DataFrame:
    """Lines are split at the first tab; a line without one is an error of the job."""
    at = F.instr("value", "\t")
    rest = F.substring("value", at + 1, F.char_length("value"))
    stop = F.raise_error(F.concat(F.lit("no tab in line: "), F.col("value"))).cast("string")
    term = F.when(at == 0, stop).otherwise(F.substring("value", F.lit(1), at - 1))
    parsed = F.from_json(F.concat(F.lit('{"v":'), rest, F.lit("}")), f"v {value_type}")
    return spark.read.text(path).where("value != ''").select(term.alias("term"), parsed["v"].alias("value"))


def write_json(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.option("compression", compression).option("ignoreNullFields", "false").json(path)


def read_json(spark: SparkSession, path: str, schema: str = "term string, value bigint") -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_parquet(df: DataFrame, path: str, compression: str = "zstd", sort: bool = True) -> None:
    """Sorted by term, so that prefix and range filters skip row groups by their least and greatest term."""
    (df.repartitionByRange("term").sortWithinPartitions("term") if sort else df).write.option("compression", compression).parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_paths(df: DataFrame, path: str) -> None:
    """Terms only; values are not kept by this form."""
    df.select("term").write.parquet(path)


def read_paths(spark: SparkSession, path: str, default: Column) -> DataFrame:
    return spark.read.parquet(path).withColumn("value", default)


def write_graph(terms: DataFrame, path: str, packed: bool = False) -> None:
    """The trie as two tables: nodes (id, depth, is_final), numbered in path order, and edges (src, label, dst).

    packed: an edge has the difference of its dst to that of the source's edge before it, in label order.
    """
    spark = terms.sparkSession
    nodes = vocab.numbered(structure.trie_nodes(terms), ["path"], "id")
    nodes.write.parquet(f"{path}/paths")  # numbers are fixed as they are stored
    nodes = spark.read.parquet(f"{path}/paths")
    nodes.select("id", "depth", "is_final").write.parquet(f"{path}/nodes")
    edges = structure.trie_edges(nodes)
    edges = edges.join(nodes.select(F.col("path").alias("src"), F.col("id").alias("_src")), "src").join(nodes.select(F.col("path").alias("dst"), F.col("id").alias("_dst")), "dst")
    edges = edges.select(F.col("_src").alias("src"), "label", F.col("_dst").alias("dst"))
    (structure.delta_coded(edges, "src", "label", "dst").drop("dst") if packed else edges).write.parquet(f"{path}/edges")
    shared.delete(spark, f"{path}/paths")


def read_graph(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Terms of a stored trie, walked level by level; a dangling edge, two parents or two roots are errors."""
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    if packed:
        edges = structure.undelta(edges, "src", "label", "dst").select("src", "label", "dst")
    known = nodes.select("id")
    dangling = edges.join(known, edges["dst"] == known["id"], "left_anti").isEmpty()
    if not dangling or not edges.groupBy("dst").count().where("count > 1").isEmpty():
        raise ValueError("not a tree: an edge without a node, or a node with two parents")
    level = nodes.where("depth = 0").select("id", F.lit("").alias("path"), "is_final")
    if level.count() > 1:
        raise ValueError("more than one root")
    out = level
    for _ in range(nodes.agg(F.max("depth")).first()[0] or 0):  # as many joins as the longest term has units
        level = level.join(edges, level["id"] == edges["src"]).select(F.col("dst").alias("id"), F.concat("path", "label").alias("path"))
        level = level.join(nodes.select("id", "is_final"), "id").select("id", "path", "is_final")
        out = out.union(level)
    return out.where("is_final").select(F.col("path").alias("term"))
