"""Dictionaries derived from the driver tables, each with the SQL of the same rows (a WITH item)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANGS = ("de", "en", "es", "fr")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("term")).agg(F.count(F.lit(1)).alias("value"))


PART = "part_terms AS (SELECT p_name AS term, count(*) AS value FROM part GROUP BY p_name)"


def tokens_of(docs: DataFrame) -> DataFrame:
    """doc_id, lang, ord, term: runs of a-z of the lower-cased texts."""
    rows = docs.select("doc_id", "lang", F.posexplode(F.split(F.lower("text"), "[^a-z]+")).alias("ord", "term"))
    return rows.where("term != ''")


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_of(read(spark, sf_dir, "documents"))


#: Bytes of texts that go to a task where it holds a row for each of their words.
TEXT_BYTES = 16 << 20


def by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents dealt by doc_id as whole texts: what is grouped by doc_id after that shuffles no words."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return docs.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TEXT_BYTES + 1), "doc_id")


TOKENS = """doc_tokens AS MATERIALIZED (SELECT * FROM (SELECT doc_id, lang, unnest(range(len(words))) AS ord, unnest(words) AS term FROM (
    SELECT doc_id, lang, regexp_split_to_array(lower(text), '[^a-z]+') AS words FROM documents)) WHERE term <> '')"""


def lang_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dict_idx (by language), term, value (count)."""
    index = F.array_position(F.array(*map(F.lit, LANGS)), F.col("lang")).cast("int") - 1
    return doc_tokens(spark, sf_dir).where(F.col("lang").isin(*LANGS)).groupBy(index.alias("dict_idx"), "term").agg(F.count(F.lit(1)).alias("value"))


LANG = f"{TOKENS}, lang_dict AS MATERIALIZED (SELECT list_position(['de','en','es','fr'], lang) - 1 AS dict_idx, term, count(*) AS value FROM doc_tokens WHERE lang IN ('de','en','es','fr') GROUP BY ALL)"


def order_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("s"))
    return rows.select("l_orderkey", F.transform("s", lambda x: x["l_partkey"].cast("decimal(20,0)")).alias("seq"))


SEQ = "order_seq AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS seq FROM lineitem GROUP BY l_orderkey)"


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as log records with commit ranks for nine of ten; the generation is the time in microseconds."""
    e = read(spark, sf_dir, "events")
    term = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    micros = F.expr("datediff(cast(ts AS date), date'1970-01-01') * 86400000000L + hour(ts) * 3600000000L + minute(ts) * 60000000L + cast(extract(SECOND FROM ts) * 1000000 AS bigint)")
    null = lambda kind: F.lit(None).cast(kind)
    delta = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).cast("long")
    entry = F.array(F.struct(term.alias("term"), null("long").alias("value"), delta.alias("delta")))
    kind = F.when(F.col("event_type") == "view", "insert").when(F.col("event_type") == "signup", "upsert").when(F.col("event_type") == "error", "remove").otherwise("batch_increment")
    value = F.when(F.col("event_type") == "signup", F.col("event_id")).when((F.col("event_type") == "view") & (F.col("event_id") % 3 == 0), F.col("event_id"))
    ranks = F.struct(F.lit("commit_rank").alias("kind"), null("string").alias("term"), null("long").alias("value"), F.col("event_id").alias("data_lsn"), micros.alias("generation"), null(entry_type()).alias("entries"))
    record = F.struct(kind.alias("kind"), term.alias("term"), value.cast("long").alias("value"), null("long").alias("data_lsn"), null("long").alias("generation"), F.when(kind == "batch_increment", entry).alias("entries"))
    both = F.when(F.col("event_id") % 10 == 0, F.array(record)).otherwise(F.array(record, ranks))
    rows = e.select("event_id", F.explode(both).alias("r"))
    return rows.select(
        F.col("event_id").alias("lsn"), "r.kind", "r.term", "r.value", null("long").alias("delta"), null("long").alias("result"), null("boolean").alias("success"),
        "r.data_lsn", "r.generation", null("long").alias("checkpoint_lsn"), "r.entries",
    )


def entry_type() -> str:
    return "array<struct<term:string,value:bigint,delta:bigint>>"


OPS = """ops AS (SELECT event_id AS lsn, 'u' || user_id AS term, epoch_us(ts) AS gen,
  CASE event_type WHEN 'view' THEN 'insert' WHEN 'signup' THEN 'upsert' WHEN 'error' THEN 'remove' ELSE 'delta' END AS op,
  CASE WHEN event_type = 'signup' OR (event_type = 'view' AND event_id % 3 = 0) THEN event_id END AS value,
  CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END AS delta FROM events)"""


def counter_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """term, seq, delta: clicks and purchases of each user."""
    e = read(spark, sf_dir, "events").where("event_type IN ('click', 'purchase')")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("term"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", 1).otherwise(2).cast("long").alias("delta"))


COUNTER = "counter_log AS (SELECT 'u' || user_id AS term, event_id AS seq, CASE event_type WHEN 'click' THEN 1 ELSE 2 END AS delta FROM events WHERE event_type IN ('click', 'purchase'))"


def doc_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a transaction: a set of each term it has once, an increment by the count of others.

    Documents whose doc_id ends in 7 take 1 from each term, which rejects them.
    """
    n = tokens_of(by_document(spark, sf_dir)).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    sets = F.coalesce((F.col("n") == 1) & (F.col("doc_id") % 10 == 0), F.lit(False))  # no doc_id: increments
    return n.select(
        "doc_id", F.col("doc_id").alias("commit_seq"), F.when(sets, "set").otherwise("increment").alias("op"), "term", F.when(sets, F.col("n")).alias("value"),
        F.when(~sets, F.when(F.col("doc_id") % 10 == 7, F.lit(-1).cast("long")).otherwise(F.col("n"))).alias("delta"), F.lit(0).alias("ordinal"),
    )


TX = f"""{TOKENS}, doc_tx AS (SELECT doc_id, term, op, CASE WHEN op = 'set' THEN n END AS value,
  CASE WHEN op = 'set' THEN NULL WHEN doc_id % 10 = 7 THEN -1 ELSE n END AS delta
  FROM (SELECT *, CASE WHEN n = 1 AND doc_id % 10 = 0 THEN 'set' ELSE 'increment' END AS op FROM (SELECT doc_id, term, count(*) AS n FROM doc_tokens GROUP BY ALL)))"""
