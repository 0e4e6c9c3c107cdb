"""Operator 10, quality rules: a short-circuit cascade in SQL functions only.

Base measures of a text are exact (see measures()). The further rules each name a reason to reject a
document. estimated_order() estimates on a sample what each rule costs and rejects, and the cascade asks the
rules in the order of rejections per cost: a CASE expression stops at the first that rejects. Both are
estimated on the rows that reach a rule: those that pass the base and the rules asked before. A rule's cost
is counted, not timed: the values that it looks at (WORK), summed over those rows; so the order is the same
on every run over the same rows. The order changes only the time: a document is rejected if any rule rejects it.

Defined cases: a null, empty or blank text has no words and fails the base; ties and repeated rows are
judged row by row; very long texts are judged whole; an empty table gives an empty result; of other columns
nothing is read (stage() carries them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import SPACE, table, words_column

MIN_WORDS = 50
#: Words of a segment in which distinct words are counted, as their share falls with length in any prose.
SEGMENT = 1000
_LINES = "aggregate({0}, 0L, (s, l) -> s + length(l))"
#: Rules by name: SQL over the columns of prepared(); true rejects. Shares are of the words, repeated lines are
#: judged by their characters and distinct words by their mean share of the segments of the whole text.
RULES: dict[str, str] = {
    "symbols": "n_symbols > 0.1 * n_words",
    "word_length": "word_chars < 2.5 * n_words OR word_chars > 12 * n_words",
    "duplicate_lines": f"n_dup_lines >= 3 AND {_LINES.format('_lines')} - {_LINES.format('array_distinct(_lines)')} > 0.3 * {_LINES.format('_lines')}",
    "no_letters": "size(filter(_words, w -> w RLIKE '\\\\p{L}')) < 0.7 * n_words",
    "shouting": "size(filter(_words, w -> w = upper(w) AND w != lower(w))) > 0.5 * n_words",
    "few_distinct_words": f"n_words >= 100 AND aggregate(sequence(0, cast((n_words - 1) div {SEGMENT} as int)), 0L, (s, k) -> s + size(array_distinct(slice(_words, 1 + {SEGMENT} * k, {SEGMENT})))) < 0.1 * n_words",
}
#: The stage asks the same rules.
STAGE_RULES = RULES
#: The values that a rule looks at in a row: SQL over the same columns; 1 for comparisons of measures.
WORK: dict[str, str] = {
    "duplicate_lines": "CASE WHEN n_dup_lines >= 3 THEN 1 + 4 * n_lines ELSE 1 END",
    "no_letters": "1 + 2 * n_words",
    "shouting": "1 + 3 * n_words",
    "few_distinct_words": "CASE WHEN n_words >= 100 THEN 1 + 2 * n_words ELSE 1 END",
}
#: Rows of the sample on which cost and selectivity are estimated; it grows no result and drops no row.
SAMPLE_ROWS = 1000


def prepared(docs: DataFrame) -> DataFrame:
    """docs with _words, _lines and the base measures.

    word_chars: code points in words; n_symbols: characters of [#*$%&|<>]; n_dup_lines: lines with a
    word that equal an earlier line; n_repeat_words: words in 3-word windows found twice or more.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("_words", words_column(F.col("text")))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    out = out.withColumn("_lines", F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACE)) != ""))
    out = out.withColumns(
        {
            "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_h": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    )
    return repeat_words(out).drop("_h", "_t", "_bits", "_sorted", "_at")


def repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words from the word hashes _h.

    The windows' hashes are sorted with their positions in the low bits; equal neighbours give the
    positions of repeated windows, of which the covered words are counted. All inside a row.
    """
    n = F.size("_h")
    df = df.withColumn(
        "_t",
        F.when(
            n >= 3,
            F.expr("zip_with(zip_with(slice(_h, 1, size(_h) - 2), slice(_h, 2, size(_h) - 2), (a, b) -> named_struct('a', a, 'b', b)), slice(_h, 3, size(_h) - 2), (p, c) -> xxhash64(p.a, p.b, c))"),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn("_bits", F.when(n < 2**20, F.lit((1 << 20) - 1).cast("long")).otherwise(F.lit((1 << 31) - 1).cast("long")))
    df = df.withColumn("_sorted", F.expr("sort_array(transform(_t, (x, i) -> (x & ~_bits) | i))"))
    df = df.withColumn(
        "_at",
        F.expr(
            "filter(zip_with(slice(_sorted, 1, greatest(size(_sorted) - 1, 0)), slice(_sorted, 2, greatest(size(_sorted) - 1, 0)),"
            " (a, b) -> CASE WHEN (a & ~_bits) = (b & ~_bits) AND _t[cast(a & _bits as int)] = _t[cast(b & _bits as int)]"
            " THEN named_struct('a', a & _bits, 'b', b & _bits) END), s -> s IS NOT NULL)"
        ),
    )
    df = df.withColumn("_at", F.expr("sort_array(array_union(transform(_at, s -> s.a), transform(_at, s -> s.b)))"))
    return df.withColumn(
        "n_repeat_words",
        F.expr(
            "CASE WHEN size(_at) = 0 THEN 0L ELSE 3L + aggregate(zip_with(slice(_at, 1, size(_at) - 1), slice(_at, 2, size(_at) - 1),"
            " (a, b) -> least(b - a, 3L)), 0L, (s, x) -> s + x) END"
        ),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def estimated_order(docs: DataFrame, rules: dict[str, str], sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Rules by rejections per cost, best first, as counted on a sample of about sample_rows rows.

    Returns dicts with name, reached (rows that ask the rule), rejected (of those) and cost (values looked at
    in a row, on average). Of rules that reject nothing more the cheapest comes first, then the first by name.
    """
    total = docs.count()
    share = min(1.0, sample_rows / total) if total else 1.0
    # chosen by content, so that it doesn't depend on how rows are dealt out
    sample = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    tests = [F.coalesce(F.expr(test), F.lit(False)).alias(f"r{i}") for i, test in enumerate(rules.values())]
    costs = [F.expr(WORK.get(name, "1")).cast("double").alias(f"c{i}") for i, name in enumerate(rules)]
    # a row for each pattern of rejecting rules, 2 ** rules at most
    rows = prepared(sample).select(base_failed().alias("base"), *tests, *costs).persist()  # or the optimizer would copy the measures into the filter
    try:
        patterns = rows.where("NOT base").groupBy(*[f"r{i}" for i in range(len(rules))])
        patterns = patterns.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(rules))]).collect()
    finally:
        rows.unpersist()
    names, out = list(rules), []
    while names:
        n = sum(p["n"] for p in patterns)
        found = []
        for name in names:
            i = list(rules).index(name)
            rejected = sum(p["n"] for p in patterns if p[f"r{i}"])
            found.append({"name": name, "reached": n, "rejected": rejected / max(n, 1), "cost": sum(p[f"c{i}"] for p in patterns) / n if n else 1.0})
        best = min(found, key=lambda r: (-r["rejected"] / r["cost"], r["cost"], r["name"]))
        out.append(best)
        names.remove(best["name"])
        patterns = [p for p in patterns if not p[f"r{list(rules).index(best['name'])}"]]
    return out


def cascade(order: list[str], rules: dict[str, str]) -> Column:
    """The first rule of the order that rejects the row, or null."""
    out = None
    for name in order:
        out = (F if out is None else out).when(F.expr(rules[name]), F.lit(name))
    return F.lit(None).cast("string") if out is None else out


def judged(docs: DataFrame, rules: dict[str, str] | None = None, order: list[str] | None = None) -> DataFrame:
    """docs with the base measures, base_failed, rejected_by and kept."""
    rules = RULES if rules is None else rules
    order = [r["name"] for r in estimated_order(docs, rules)] if order is None else order
    out = prepared(docs).withColumn("base_failed", base_failed())
    out = out.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(order, rules)))
    return out.withColumn("kept", F.col("rejected_by").isNull())


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that neither the base nor a rule rejects, columns unchanged."""
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "text")  # whatever other columns are called
    # the row number keeps the optimizer from copying the measures' expressions into the filter
    out = judged(rows).withColumn("_number", F.monotonically_increasing_id())
    return out.where((F.col("_number") >= 0) & F.col("kept")).select("_row.*")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
t AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
      FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM t QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, words, 
        list_sum(list_transform(lines, lambda l: length(l))) AS line_chars, list_sum(list_transform(list_distinct(lines), lambda l: length(l))) AS distinct_chars,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols > 0.1 * n_words OR word_chars < 2.5 * n_words OR word_chars > 12 * n_words
    OR (n_dup_lines >= 3 AND line_chars - distinct_chars > 0.3 * line_chars)
    OR len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) < 0.7 * n_words
    OR len(list_filter(words, lambda x: x = upper(x) AND x != lower(x))) > 0.5 * n_words
    OR (n_words >= 100 AND list_sum(list_transform(range((n_words - 1) // 1000 + 1), lambda k: len(list_distinct(words[1000 * k + 1:1000 * (k + 1)])))) < 0.1 * n_words)) AS kept
FROM b
"""
