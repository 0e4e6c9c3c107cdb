"""Named queries over the driver tables, each with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import units
from termloom.operators import counters, oplog, setops, structure, substring, vocab
from termloom.operators.dictionary import Dictionary
from termloom.plans import views
from termloom.sources import formats, shared
from termloom.sources.store import Store
from termloom.streaming import replay

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "oplog_reconcile"


def query(sql: str | None = None, **queries: Query) -> None:
    for name, run in queries.items():
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql


def part(spark: SparkSession, sf_dir: str) -> Dictionary:
    return Dictionary(views.part_terms(spark, sf_dir))


def lang(spark: SparkSession, sf_dir: str, name: str) -> Dictionary:
    index = views.LANGS.index(name)
    return Dictionary(views.lang_dict(spark, sf_dir).where(F.col("dict_idx") == index).select("term", "value"))


def rows(spark: SparkSession, values: list, schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def with_part(body: str) -> str:
    return f"WITH {views.PART} {body}"


def with_lang(body: str, more: str = "") -> str:
    return f"WITH {views.LANG}{more} {body}"


# --- sources and sinks: written to the shared folder and read back


def round_trip(write, read) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = shared.fresh(spark, "format")
        write(views.part_terms(spark, sf_dir), path)
        return read(spark, path)

    return run


query(with_part("SELECT term FROM part_terms WHERE term <> ''"), format_lines=round_trip(lambda df, p: formats.write_lines(df, p), formats.read_lines), format_lines_gzip=round_trip(lambda df, p: formats.write_lines(df, p, "gzip"), formats.read_lines))
query(with_part("SELECT term FROM part_terms"), format_graph=round_trip(formats.write_graph, formats.read_graph), format_graph_packed=round_trip(lambda df, p: formats.write_graph(df, p, True), lambda s, p: formats.read_graph(s, p, True)))
query(
    with_part("SELECT term, value FROM part_terms"),
    format_tsv=round_trip(formats.write_tsv, formats.read_tsv),
    format_json=round_trip(formats.write_json, formats.read_json),
    format_parquet=round_trip(formats.write_parquet, formats.read_parquet),
)
query(with_part("SELECT term, CAST(0 AS BIGINT) AS value FROM part_terms"), format_paths=round_trip(formats.write_paths, lambda s, p: formats.read_paths(s, p, F.lit(0).cast("long"))))


def last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dictionary.from_terms_with_values(views.read(spark, sf_dir, "part"), "p_name", "p_partkey", "p_partkey").df


query("SELECT p_name AS term, max(p_partkey) AS value FROM part GROUP BY p_name", build_last_value=last_value)
query(f"WITH {views.TOKENS} SELECT DISTINCT term FROM doc_tokens", build_terms=lambda s, d: Dictionary.from_terms(views.doc_tokens(s, d)).df)

# --- lookup

PROBES = ["red", "zzz", "", "and", "the"]


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "part").select(F.split("p_name", " ")[0].alias("term")).union(rows(spark, [(p,) for p in PROBES], "term string")).distinct()


PROBE = "probes AS (SELECT DISTINCT term FROM (SELECT split_part(p_name, ' ', 1) AS term FROM part UNION ALL SELECT unnest(['red','zzz','','and','the'])))"
query(with_lang("SELECT p.term, EXISTS (SELECT 1 FROM lang_dict l WHERE dict_idx = 1 AND l.term = p.term) AS found FROM probes p", f", {PROBE}"), contains_probe=lambda s, d: lang(s, d, "en").contains(probes(s, d)))
query(with_lang("SELECT p.term, l.value FROM probes p LEFT JOIN (SELECT * FROM lang_dict WHERE dict_idx = 1) l USING (term)", f", {PROBE}"), value_lookup=lambda s, d: lang(s, d, "en").get_value(probes(s, d)))
query(with_lang("SELECT p.term FROM probes p SEMI JOIN (SELECT * FROM lang_dict WHERE dict_idx = 1 AND value > 3) l USING (term)", f", {PROBE}"), contains_with_value=lambda s, d: lang(s, d, "en").contains_with_value(probes(s, d), lambda v: v > 3))


def set_valued(spark: SparkSession, sf_dir: str) -> Dictionary:
    own = views.read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("term")).agg(F.array_sort(F.collect_set("p_size")).alias("value"))
    return Dictionary(own)


def any_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = set_valued(spark, sf_dir)
    return d.df.select("term", d.matches_any(lambda x: x > 45).alias("any_large"), d.matches_all(lambda x: x > 5).alias("all_large"))


query("SELECT p_name AS term, bool_or(p_size > 45) AS any_large, bool_and(p_size > 5) AS all_large FROM part GROUP BY 1", value_any_all=any_all)
query(with_part("SELECT count(*) AS n_terms FROM part_terms"), dictionary_size=lambda s, d: part(s, d).size())


def sequences(spark: SparkSession, sf_dir: str) -> Dictionary:
    return Dictionary(views.order_seq(spark, sf_dir).select(F.col("seq").alias("term"), F.col("l_orderkey").alias("value")), "u64")


query(
    f"WITH {views.SEQ}, p AS (SELECT DISTINCT list_sort(seq) AS seq FROM order_seq) SELECT l_orderkey FROM order_seq SEMI JOIN p USING (seq)",
    sequence_lookup=lambda s, d: views.order_seq(s, d).join(views.order_seq(s, d).select(F.array_sort("seq").alias("seq")).distinct(), "seq", "left_semi").select("l_orderkey"),
)
query(
    f"WITH {views.SEQ}, p AS (SELECT DISTINCT seq[1] AS head FROM order_seq WHERE len(seq) = 1) SELECT l_orderkey FROM order_seq WHERE seq[1] IN (SELECT head FROM p)",
    sequence_prefix=lambda s, d: sequences(s, d).with_any_prefix(views.order_seq(s, d).where(F.size("seq") == 1).select(F.col("seq").alias("prefix"))).df.select(F.col("value").alias("l_orderkey")),
)


def vector_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: units.bits_of_double(x.cast("double"))).alias("seq"))
    return e.join(e.groupBy("seq").agg(F.min("vec_id").alias("first_id")), "seq").select("vec_id", "first_id")


query("SELECT vec_id, min(vec_id) OVER (PARTITION BY embedding) AS first_id FROM embeddings", vector_lookup=vector_keys)


def bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the dictionary that its Bloom filter misses: none."""
    terms = part(spark, sf_dir).df.select("term")
    bits = structure.bloom_bits(terms.count())
    found = structure.bloom_might_contain(structure.bloom_build(terms, bits), terms, bits)
    return found.agg(F.count(F.lit(1)).alias("members"), F.count(F.when(~F.col("might_contain"), 1)).alias("missed"))


query(with_part("SELECT count(*) AS members, CAST(0 AS BIGINT) AS missed FROM part_terms"), bloom_members=bloom)

# --- prefixes

query(with_part("SELECT * FROM part_terms WHERE starts_with(term, 'red ')"), prefix_scan=lambda s, d: part(s, d).with_prefix("red ").df)
query(with_part("SELECT * FROM part_terms WHERE starts_with(term, 're') AND NOT starts_with(term, 'red a') AND NOT starts_with(term, 'red b')"), prefix_excluding=lambda s, d: part(s, d).with_prefix("re").excluding("red a", "red b").df)
PREFIXES = ["a", "re", "the", "inter", "zzz"]
MANY = "p AS (SELECT unnest(['a','re','the','inter','zzz']) AS prefix)"
query(
    with_lang("SELECT DISTINCT l.term, l.value FROM lang_dict l, p WHERE dict_idx = 1 AND starts_with(l.term, p.prefix)", f", {MANY}"),
    prefix_many=lambda s, d: lang(s, d, "en").with_any_prefix(rows(s, [(p,) for p in PREFIXES], "prefix string")).df,
)
query(
    with_lang("SELECT term, value FROM lang_dict l WHERE dict_idx = 1 AND NOT EXISTS (SELECT 1 FROM p WHERE starts_with(l.term, p.prefix))", f", {MANY}"),
    prefix_excluding_many=lambda s, d: lang(s, d, "en").excluding_any(rows(s, [(p,) for p in PREFIXES], "prefix string")).df,
)
BYTE_PREFIXES = ["f", "d\u00e4", "\u00fc", "\u65e5"]
WORDS_OF = "w AS MATERIALIZED (SELECT DISTINCT unnest(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+')) AS term FROM documents)"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("term")).distinct()


query(
    f"WITH {WORDS_OF} SELECT term FROM w WHERE " + " OR ".join(f"starts_with(term, '{p}')" for p in BYTE_PREFIXES),
    prefix_many_byte=lambda s, d: Dictionary(words(s, d), "byte").with_any_prefix(rows(s, [(p,) for p in BYTE_PREFIXES], "prefix string")).df,
)
query(
    f"WITH {WORDS_OF} SELECT lower(hex(encode(term)[2:2])) AS label, bool_or(strlen(term) = 2) AS is_final FROM w WHERE starts_with(term, 'f') AND strlen(term) > 1 GROUP BY 1",
    children_byte=lambda s, d: Dictionary(words(s, d), "byte").children("f").select(F.lower(F.hex("label")).alias("label"), "is_final"),
)


def rarely_valued(spark: SparkSession, sf_dir: str) -> Dictionary:
    """The English terms; those met once have no value."""
    return Dictionary(lang(spark, sf_dir, "en").df.select("term", F.when(F.col("value") > 1, F.col("value")).alias("value")))


RARE = "(SELECT term, CASE WHEN value > 1 THEN value END AS value FROM lang_dict WHERE dict_idx = 1)"
query(with_lang(f"SELECT term, value FROM {RARE} WHERE starts_with(term, 're')"), prefix_values_missing=lambda s, d: rarely_valued(s, d).with_prefix("re").df)
query(with_lang(f"SELECT term, value FROM {RARE} WHERE NOT starts_with(term, 're') AND NOT starts_with(term, 'a')"), excluding_values_missing=lambda s, d: rarely_valued(s, d).excluding("re", "a").df)
query(with_lang("SELECT term, value FROM lang_dict WHERE dict_idx = 1 AND term > 'm' ORDER BY term LIMIT 50"), cursor_page=lambda s, d: lang(s, d, "en").page_after("m", 50))
query(with_lang("SELECT substr(term, 3, 1) AS label, bool_or(length(term) = 3) AS is_final FROM lang_dict WHERE dict_idx = 1 AND starts_with(term, 're') AND length(term) > 2 GROUP BY 1"), children_at_prefix=lambda s, d: lang(s, d, "en").children("re"))
query(with_part("SELECT term, value FROM part_terms WHERE NOT starts_with(term, 'b')"), remove_prefix=lambda s, d: part(s, d).remove_prefix("b").df)
query(
    with_part("SELECT term, CASE WHEN term[1:8] = 'red rose'[1:8] THEN 8 ELSE (SELECT max(i) FROM range(0, 9) t(i) WHERE term[1:i] = 'red rose'[1:i] AND i <= length(term)) END AS lcp FROM part_terms"),
    common_prefix=lambda s, d: part(s, d).df.select("term", units.common_prefix(F.col("term"), F.lit("red rose")).cast("long").alias("lcp")),
)

# --- substrings


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("string_id"), F.col("text").alias("term"))


PATTERN = "er"
FOUND = "SELECT term, i - 1 AS pos FROM (SELECT term, unnest(range(1, length(term) + 1)) AS i FROM {0}) WHERE substr(term, i, {1}) = '{2}'"
OCC = FOUND.format("(SELECT text AS term FROM benchmark)", 2, PATTERN)
BYTES = "SELECT term, i - 1 AS pos FROM (SELECT term, unnest(range(1, strlen(term) + 1)) AS i FROM (SELECT text AS term FROM documents WHERE contains(text, 'für'))) WHERE encode(term)[i:i + 3] = encode('für')"
query(f"SELECT term, CAST(pos AS INTEGER) AS pos FROM ({OCC})", substr_locations_char=lambda s, d: substring.occurrences(texts(s, d), PATTERN))
query(f"SELECT count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos FROM ({BYTES})", substr_locations_byte=lambda s, d: substring.occurrences(views.read(s, d, "documents").select(F.col("text").alias("term")), "für", "byte").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("sum_pos")))
query(f"SELECT count(*) AS freq FROM ({OCC})", substr_freq=lambda s, d: substring.frequency(texts(s, d), PATTERN))
query("SELECT CAST(sum(length(text) + 1) AS BIGINT) AS freq FROM benchmark", substr_freq_empty=lambda s, d: substring.frequency(texts(s, d), ""))
query("SELECT count(*) AS n_matches FROM benchmark", substr_count_empty=lambda s, d: substring.match_count(texts(s, d), ""))
query(f"SELECT term, CAST(pos AS INTEGER) AS pos FROM ({OCC}) ORDER BY term, pos LIMIT 20", substr_limited=lambda s, d: substring.limited(texts(s, d), PATTERN, 20))
query("SELECT bool_or(contains(text, 'what')) AS found FROM benchmark", substr_contains=lambda s, d: substring.contains(texts(s, d), "what"))
query("SELECT item_id AS string_id, CAST(length(text) AS INTEGER) AS text_len FROM benchmark WHERE suffix(text, '?')", substr_ending=lambda s, d: substring.ending_with(texts(s, d), "?"))
query(
    f"SELECT term, CAST(pos AS INTEGER) AS pos, substr(term, pos + 1, 2) AS matched, substr(term, 1, pos) AS before, substr(term, pos + 3) AS after, CAST(pos AS INTEGER) AS left_len, CAST(length(term) - pos - 2 AS INTEGER) AS right_len FROM ({OCC})",
    substr_contexts=lambda s, d: substring.contexts(substring.occurrences(texts(s, d), PATTERN), PATTERN),
)
query(f"SELECT substr(term, pos, 1) AS label, count(*) AS n FROM ({OCC}) WHERE pos > 0 GROUP BY 1", left_extensions=lambda s, d: substring.extensions(texts(s, d), PATTERN))
query(f"SELECT substr(term, pos + 3, 1) AS label, count(*) AS n FROM ({OCC}) WHERE pos + 3 <= length(term) GROUP BY 1", right_extensions=lambda s, d: substring.extensions(texts(s, d), PATTERN, "right"))
PATTERNS = ["ro", "red", "e", "and", "zzz"]
query(
    with_part("SELECT pattern, term, CAST(i - 1 AS INTEGER) AS pos FROM (SELECT term, unnest(range(1, length(term) + 1)) AS i FROM part_terms), (SELECT unnest(['ro','red','e','and','zzz']) AS pattern) WHERE substr(term, i, length(pattern)) = pattern"),
    substr_many=lambda s, d: substring.occurrences_of_many(part(s, d).df, rows(s, [(p,) for p in PATTERNS], "pattern string")),
)
FUZZY = [("reading", 1), ("people", 2), ("station", 2), ("number", 1)]
query(
    with_lang("SELECT q AS query, term, levenshtein(q, term) AS distance FROM (SELECT DISTINCT term FROM lang_dict), (VALUES ('reading', 1), ('people', 2), ('station', 2), ('number', 1)) v(q, b) WHERE levenshtein(q, term) <= b").replace("levenshtein(q, term) AS distance", "CAST(levenshtein(q, term) AS INTEGER) AS distance"),
    fuzzy_candidates=lambda s, d: substring.fuzzy(setops.union(views.lang_dict(s, d)), rows(s, FUZZY, "query string, budget int")),
)
query(
    with_part("SELECT count(DISTINCT substr(term, i, n)) AS n FROM (SELECT term, i, unnest(range(1, length(term) - i + 2)) AS n FROM (SELECT term, unnest(range(1, length(term) + 1)) AS i FROM part_terms))"),
    distinct_substrings=lambda s, d: substring.distinct_substrings(part(s, d).df).agg(F.count(F.lit(1)).alias("n")),
)
query(None, endpos_classes=lambda s, d: substring.endpos_classes(part(s, d).df))

# --- set algebra

query(with_lang("SELECT DISTINCT term FROM lang_dict"), union_set=lambda s, d: setops.union(views.lang_dict(s, d)))
for name, strategy, sql in (
    ("union_first", setops.first_wins, "arg_min(value, dict_idx)"),
    ("union_last", setops.last_wins, "arg_max(value, dict_idx)"),
    ("union_join", setops.join_numbers, "max(value)"),
    ("union_meet", setops.meet_numbers, "min(value)"),
    ("union_sum", setops.summed, "CAST(sum(value) AS BIGINT)"),
    ("union_custom", setops.folded(lambda old, new: old * 2 + new), "list_reduce(list(value ORDER BY dict_idx), lambda x, y: x * 2 + y)"),
):
    query(with_lang(f"SELECT term, {sql} AS value FROM lang_dict GROUP BY term"), **{name: lambda s, d, f=strategy: setops.union_valued(views.lang_dict(s, d), f)})


def tag_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.read(spark, sf_dir, "part")
    return p.groupBy((F.col("p_size") % 2).alias("dict_idx"), F.split("p_name", " ")[0].alias("term")).agg(F.array_sort(F.collect_set((F.col("p_size") / 2).cast("int"))).alias("value"))


TAGSETS = "t AS (SELECT p_size % 2 AS dict_idx, split_part(p_name, ' ', 1) AS term, list_sort(list(DISTINCT p_size // 2)) AS value FROM part GROUP BY ALL)"
query(f"WITH {TAGSETS} SELECT term, list_sort(list_distinct(flatten(list(value)))) AS value FROM t GROUP BY term", union_join_sets=lambda s, d: setops.union_valued(tag_sets(s, d), setops.join_sets))
query(
    f"WITH {TAGSETS} SELECT a.term, list_sort(list_intersect(a.value, b.value)) AS value FROM t a JOIN t b ON a.term = b.term AND a.dict_idx = 0 AND b.dict_idx = 1",
    intersect_meet_sets=lambda s, d: setops.intersection_valued(tag_sets(s, d), 2, setops.meet_sets),
)
query(with_lang("SELECT term FROM lang_dict GROUP BY term HAVING count(*) = 4"), intersect_set=lambda s, d: setops.intersection(views.lang_dict(s, d), 4))
query(with_lang("SELECT term, min(value) AS value FROM lang_dict GROUP BY term HAVING count(*) = 4"), intersect_all_langs=lambda s, d: setops.intersection_valued(views.lang_dict(s, d), 4))


def null_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.lang_dict(spark, sf_dir).select("dict_idx", "term", F.when(F.col("value") > 2, F.array("value")).alias("value"))


query(
    with_lang("SELECT term, CASE WHEN count(CASE WHEN value > 2 THEN 1 END) = 0 THEN NULL WHEN min(CASE WHEN value > 2 THEN value END) = max(CASE WHEN value > 2 THEN value END) THEN [min(CASE WHEN value > 2 THEN value END)] ELSE [] END AS value FROM lang_dict GROUP BY term HAVING count(*) = 4"),
    intersect_null_values=lambda s, d: setops.intersection_valued(null_sets(s, d), 4, setops.meet_sets),
)
FLAGS = "(SELECT dict_idx, term, value > 1 AS value FROM lang_dict)"


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.lang_dict(spark, sf_dir).select("dict_idx", "term", (F.col("value") > 1).alias("value"))


query(with_lang(f"SELECT term, bool_or(value) AS value FROM {FLAGS} GROUP BY term"), union_join_flags=lambda s, d: setops.union_valued(flags(s, d), setops.join_flags))
query(with_lang(f"SELECT term, bool_and(value) AS value FROM {FLAGS} GROUP BY term"), union_meet_flags=lambda s, d: setops.union_valued(flags(s, d), setops.meet_flags))
query(with_lang("SELECT term, value FROM lang_dict a WHERE dict_idx = 1 AND NOT EXISTS (SELECT 1 FROM lang_dict b WHERE b.dict_idx = 0 AND a.term = b.term)"), difference_en_de=lambda s, d: setops.difference(lang(s, d, "en").df, lang(s, d, "de").df))
query(with_lang("SELECT term, max(value) AS value, CAST(min(dict_idx) AS INTEGER) AS source_idx FROM lang_dict GROUP BY term HAVING count(*) = 1"), symdiff_langs=lambda s, d: setops.symmetric_difference(views.lang_dict(s, d)))
query(with_lang("SELECT term, a.value AS left_value, b.value AS right_value FROM lang_dict a JOIN lang_dict b USING (term) WHERE a.dict_idx = 1 AND b.dict_idx = 3 AND a.value <> b.value"), value_diff_en_fr=lambda s, d: setops.value_diff(lang(s, d, "en").df, lang(s, d, "fr").df))
query(with_lang("SELECT count(DISTINCT dict_idx) AS dictionaries, count(DISTINCT CASE WHEN starts_with(term, 'qu') THEN dict_idx END) AS active FROM lang_dict"), active_dictionaries=lambda s, d: setops.active_dictionaries(views.lang_dict(s, d), "qu"))
EN_DE = "FROM (SELECT * FROM lang_dict WHERE dict_idx = 1) a FULL JOIN (SELECT * FROM lang_dict WHERE dict_idx = 0) b USING (term)"
query(with_lang(f"SELECT term, coalesce(a.value, 0) + coalesce(b.value, 0) AS value {EN_DE}"), merge_with_sum=lambda s, d: lang(s, d, "en").merge(lang(s, d, "de").df, lambda a, b: a + b, skip_null=True).df)

# --- mutation

query(with_lang(f"SELECT term, coalesce(b.value, a.value) AS value {EN_DE}"), upsert_apply=lambda s, d: lang(s, d, "en").upsert(lang(s, d, "de").df).df, union_replace=lambda s, d: lang(s, d, "en").merge(lang(s, d, "de").df, lambda a, b: b).df)
query(with_lang(f"SELECT term, coalesce(a.value, b.value) AS value {EN_DE}"), get_or_insert=lambda s, d: lang(s, d, "en").get_or_insert(lang(s, d, "de").df).df)
query(with_lang(f"SELECT term, a.value AS value {EN_DE}"), insert_members=lambda s, d: lang(s, d, "en").insert(lang(s, d, "de").df).df)
query(with_lang("SELECT count(*) AS n_new FROM (SELECT term FROM lang_dict WHERE dict_idx = 0 EXCEPT SELECT term FROM lang_dict WHERE dict_idx = 1)"), insert_new_count=lambda s, d: lang(s, d, "en").new_terms(lang(s, d, "de").df).agg(F.count(F.lit(1)).alias("n_new")))
query(with_lang("SELECT term, value FROM lang_dict WHERE dict_idx = 1 AND term NOT IN (SELECT term FROM lang_dict WHERE dict_idx = 3)"), remove_apply=lambda s, d: lang(s, d, "en").remove(lang(s, d, "fr").df).df)
query(with_lang(f"SELECT term, CASE WHEN a.term IS NULL THEN 100 WHEN b.term IS NULL THEN a.value ELSE a.value + 1 END AS value {EN_DE}".replace("USING (term)", "ON a.term = b.term").replace("SELECT term", "SELECT coalesce(a.term, b.term) AS term")), update_or_insert=lambda s, d: lang(s, d, "en").update_or_insert(lang(s, d, "de").df, 100, lambda v: v + 1).df)


def swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = lang(spark, sf_dir, "de").df.select("term", F.when(F.col("value") > 1, F.col("value")).alias("expected"), F.lit(-1).cast("long").alias("value"))
    return lang(spark, sf_dir, "en").compare_and_swap(changes)[0].df


query(
    with_lang("SELECT coalesce(a.term, c.term) AS term, CASE WHEN c.term IS NULL OR a.value IS DISTINCT FROM c.expected THEN a.value ELSE -1 END AS value FROM (SELECT * FROM lang_dict WHERE dict_idx = 1) a FULL JOIN c ON a.term = c.term WHERE a.term IS NOT NULL OR c.expected IS NULL", ", c AS (SELECT term, CASE WHEN value > 1 THEN value END AS expected FROM lang_dict WHERE dict_idx = 0)"),
    compare_and_swap=swaps,
)
query(f"WITH {views.COUNTER} SELECT term, CAST(sum(delta) AS BIGINT) AS value FROM counter_log GROUP BY term", counter_fold=lambda s, d: counters.increment(rows(s, [], "term string, value bigint"), views.counter_log(s, d)))
query(
    f"WITH {views.COUNTER} SELECT term, seq, delta, CAST(sum(delta) OVER (PARTITION BY term ORDER BY seq) AS BIGINT) AS value_after, CAST(sum(delta) OVER (PARTITION BY term ORDER BY seq) - delta AS BIGINT) AS value_before FROM counter_log".replace("THEN 1 ELSE 2 END AS delta", "THEN CAST(1 AS BIGINT) ELSE 2 END AS delta"),
    fetch_add=lambda s, d: counters.fetch_add(views.counter_log(s, d), span=1000),
)
BAD = "bad AS (SELECT DISTINCT doc_id FROM doc_tx WHERE delta < 0)"
query(f"WITH {views.TX}, {BAD} SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM bad) AS committed, count(*) AS n_ops FROM doc_tx GROUP BY doc_id", doc_tx_verdicts=lambda s, d: counters.commit_transactions(views.doc_tx(s, d))[0])
query(
    f"""WITH {views.TX}, {BAD}, ok AS (SELECT * FROM doc_tx WHERE doc_id NOT IN (SELECT doc_id FROM bad)),
    l AS (SELECT term, max(CASE WHEN op = 'set' THEN doc_id END) AS last FROM ok GROUP BY term)
    SELECT term, CAST(coalesce(max(CASE WHEN op = 'set' AND doc_id = last THEN value END), 0) + coalesce(sum(CASE WHEN op = 'increment' AND (last IS NULL OR doc_id >= last) THEN delta END), 0) AS BIGINT) AS value
    FROM ok JOIN l USING (term) GROUP BY term""",
    doc_tx_commit=lambda s, d: counters.commit_transactions(views.doc_tx(s, d))[1],
)

# --- vocabulary and bijection


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.doc_tokens(spark, sf_dir).select("term", F.struct("doc_id", "ord").alias("first_seen"))


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = rows(spark, [("the", 5), ("qqqq", 6)], "term string, id bigint")
    return vocab.assign(known, seen(spark, sf_dir), 5)


VOCAB = f"WITH {views.TOKENS}, f AS (SELECT term, min((doc_id, ord)) AS seen FROM doc_tokens GROUP BY term) "
query(VOCAB + "SELECT term, row_number() OVER (ORDER BY seen, term) - 1 AS id FROM f", vocab_assign=lambda s, d: vocab.assign(None, seen(s, d)))
query(VOCAB + "SELECT term, row_number() OVER (ORDER BY seen, term) + 6 AS id FROM f WHERE term <> 'the' UNION ALL SELECT unnest(['the', 'qqqq']), unnest([5::BIGINT, 6])", vocab_extend=assigned)
query(
    "SELECT * FROM (VALUES ('the', 5::BIGINT, 'identical'), ('the', 9, 'term_has_other_id'), ('new', 6, 'id_taken'), ('low', 2, 'below_start'), ('fine', 20, 'inserted')) t(term, id, outcome)",
    vocab_insert_with_index=lambda s, d: vocab.insert_with_index(rows(s, [("the", 5), ("qqqq", 6)], "term string, id bigint"), rows(s, [("the", 5), ("the", 9), ("new", 6), ("low", 2), ("fine", 20)], "term string, id bigint"), 5),
)
VOCAB_OF = f"WITH {views.TOKENS}, f AS (SELECT term, min((doc_id, ord)) AS seen FROM doc_tokens WHERE lang = 'en' GROUP BY term), v AS MATERIALIZED (SELECT term, row_number() OVER (ORDER BY seen, term) - 1 AS id FROM f)"


def english_vocab(spark: SparkSession, sf_dir: str, name: str = "en") -> DataFrame:
    return vocab.assign(None, views.doc_tokens(spark, sf_dir).where(F.col("lang") == name).select("term", F.struct("doc_id", "ord").alias("first_seen")))


query(VOCAB_OF + f", {PROBE} SELECT term, id FROM probes LEFT JOIN v USING (term)", vocab_index_of=lambda s, d: vocab.index_of(english_vocab(s, d), probes(s, d)))
query(VOCAB_OF + ", i AS (SELECT DISTINCT CAST(p_size AS BIGINT) * 37 AS id FROM part) SELECT id, term FROM i LEFT JOIN v USING (id)", vocab_term_of=lambda s, d: vocab.term_of(english_vocab(s, d), views.read(s, d, "part").select((F.col("p_size").cast("long") * 37).alias("id")).distinct()))
query(
    VOCAB_OF + """, g AS (SELECT term, min((doc_id, ord)) AS seen FROM doc_tokens WHERE lang = 'de' GROUP BY term),
    n AS (SELECT term, row_number() OVER (ORDER BY seen, term) - 1 + (SELECT count(*) FROM v) AS id FROM g WHERE term NOT IN (SELECT term FROM v)) SELECT * FROM v UNION ALL SELECT * FROM n""",
    vocab_union=lambda s, d: vocab.union_with(english_vocab(s, d), english_vocab(s, d, "de")),
)
PAIRS = "p AS (SELECT p_name AS term, p_partkey % 50 AS value FROM part)"
query(
    f"WITH {PAIRS} SELECT term, value, CASE WHEN t > 1 THEN 'duplicate_term' ELSE 'duplicate_value' END AS error FROM (SELECT *, count(*) OVER (PARTITION BY term) AS t, count(*) OVER (PARTITION BY value) AS v FROM p) WHERE t > 1 OR v > 1",
    bijection_check=lambda s, d: vocab.bijection_conflicts(views.read(s, d, "part").select(F.col("p_name").alias("term"), (F.col("p_partkey") % 50).alias("value"))),
)
query(with_part("SELECT value, term FROM part_terms"), bijection_inverse=lambda s, d: vocab.inverse(part(s, d).df))

# --- structure

PATHS = "(SELECT term, i, substr(term, 1, i) AS path FROM (SELECT term, unnest(range(0, length(term) + 1)) AS i FROM part_terms))"
query(with_part(f"SELECT path, CAST(any_value(i) AS INTEGER) AS depth, bool_or(i = length(term)) AS is_final FROM {PATHS} GROUP BY path"), trie_nodes=lambda s, d: structure.trie_nodes(part(s, d).df))
query(with_part(f"SELECT DISTINCT substr(path, 1, i - 1) AS src, substr(path, i, 1) AS label, path AS dst FROM {PATHS} WHERE i > 0"), trie_edges=lambda s, d: structure.trie_edges(structure.trie_nodes(part(s, d).df)))
query(
    with_part(f"SELECT count(*) AS n_paths, any_value(list_contains(s, '')) AS is_final, CAST(any_value(len(s)) AS INTEGER) AS n_suffixes FROM (SELECT path, list_sort(list(DISTINCT substr(term, i + 1))) AS s FROM {PATHS} GROUP BY path) GROUP BY s"),
    dawg_states=lambda s, d: structure.dawg_states(part(s, d).df).drop("state"),
)

query(
    with_lang("SELECT (SELECT count(DISTINCT term) FROM lang_dict) AS n_terms, count(DISTINCT path) AS n_nodes, count(DISTINCT path) - 1 AS n_edges, CAST(max(length(path)) AS INTEGER) AS depth FROM (SELECT substr(term, 1, i) AS path FROM (SELECT term, unnest(range(0, length(term) + 1)) AS i FROM lang_dict))"),
    node_counts=lambda s, d: structure.counts(setops.union(views.lang_dict(s, d))),
)

# --- the operation log


def ranked_ops(spark: SparkSession, sf_dir: str, overlay: bool = True, checkpoint: int | None = None) -> DataFrame:
    log = views.event_log(spark, sf_dir)
    return oplog.ranked(log, oplog.operations(log), overlay, checkpoint)


def reconciled(where: str, generation: str = "gen") -> str:
    return f"""WITH {views.OPS}, o AS (SELECT * REPLACE ({generation} AS gen) FROM ops WHERE {where}),
    l AS (SELECT term, arg_max(struct_pack(gen := gen, lsn := lsn, op := op, v := value), (gen, lsn)) AS last FROM o WHERE op IN ('upsert', 'remove') GROUP BY term),
    r AS (SELECT o.*, last FROM o LEFT JOIN l USING (term) WHERE last IS NULL OR (o.gen, o.lsn) >= (last.gen, last.lsn)),
    s AS (SELECT term, any_value(last) AS last, count(CASE WHEN op NOT IN ('upsert', 'remove') THEN 1 END) AS later, sum(delta) AS total,
      arg_min(CASE WHEN op = 'insert' THEN value END, (gen, lsn)) AS given,
      min(CASE WHEN op = 'insert' AND value IS NOT NULL THEN (gen, lsn) END) AS given_at, min(CASE WHEN op = 'delta' THEN (gen, lsn) END) AS delta_at FROM r GROUP BY term),
    t AS (SELECT *, coalesce(CASE WHEN last.op = 'upsert' THEN last.v END, CASE WHEN delta_at IS NULL OR given_at < delta_at THEN given END) AS start FROM s)
    SELECT term, CAST(CASE WHEN total IS NULL THEN start ELSE coalesce(start, 0) + total END AS BIGINT) AS value FROM t WHERE (last IS NOT NULL AND last.op = 'upsert') OR later > 0"""


OVERLAY, OWNED = reconciled("lsn % 10 <> 0"), reconciled("true", "CASE WHEN lsn % 10 = 0 THEN lsn ELSE gen END")
query(OVERLAY, oplog_reconcile=lambda s, d: oplog.reconcile(ranked_ops(s, d)))
query(OWNED, oplog_reconcile_owned=lambda s, d: oplog.reconcile(ranked_ops(s, d, False)))
query(reconciled("lsn % 10 <> 0 AND lsn > 500"), oplog_after_checkpoint=lambda s, d: oplog.reconcile(ranked_ops(s, d, True, 500)))


def durable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log before a bad record, the one at four fifths of it."""
    log = views.event_log(spark, sf_dir)
    bad = log.agg(F.max("lsn")).first()[0] * 4 // 5
    return oplog.operations(oplog.durable_prefix(log, F.col("lsn") == bad)).drop("n")


query(f"WITH {views.OPS} SELECT lsn, op, term, value, CAST(delta AS BIGINT) AS delta FROM ops WHERE lsn < (SELECT max(event_id) * 4 // 5 FROM events)", oplog_durable_prefix=durable)
query(
    "WITH c AS (SELECT event_id AS lsn FROM events WHERE event_id NOT IN (700, 900)), s AS (SELECT min(event_id) AS low FROM events) SELECT CAST(max(CASE WHEN lsn - low + 1 = n THEN lsn END) AS BIGINT) AS watermark FROM (SELECT lsn, row_number() OVER (ORDER BY lsn) AS n FROM c), s",
    committed_watermark=lambda s, d: oplog.committed_watermark(views.read(s, d, "events").select(F.col("event_id").alias("lsn")).where("lsn NOT IN (700, 900)"), views.read(s, d, "events").agg(F.min("event_id")).first()[0]),
)
query("SELECT (event_id - 1) // 100 AS epoch_id, min(event_id) AS first_lsn, max(event_id) AS last_lsn, count(*) AS n_ops FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 5", log_epochs=lambda s, d: oplog.epochs(views.read(s, d, "events").select(F.col("event_id").alias("lsn")), 100, 5))


def stored_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in two segments with a checkpoint after each, a compaction, and a repair at opening."""
    path = shared.fresh(spark, "store")
    store = Store.create(spark, path, overlay=True)
    log = views.event_log(spark, sf_dir)
    middle = log.agg(F.max("lsn")).first()[0] // 2
    for records in (log.where(F.col("lsn") <= middle), log.where(F.col("lsn") > middle)):
        store.append(records)
        store.checkpoint()
    store.compact()
    return Store.open_with_recovery(spark, path)[0].read()


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as files of a stream, applied batch by batch to a store."""
    path = shared.fresh(spark, "stream")
    views.event_log(spark, sf_dir).repartitionByRange(4, "lsn").write.parquet(f"{path}/log")
    store = Store.create(spark, f"{path}/store", overlay=True)
    records = spark.readStream.schema(oplog.SCHEMA).parquet(f"{path}/log")
    replay.replay(store, records, f"{path}/checkpoint").awaitTermination()
    return Store.open(spark, f"{path}/store").read()


query(OVERLAY, store_checkpoints=stored_twice, stream_replay=streamed)
