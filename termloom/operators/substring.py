"""Substring search over a table of terms or texts: occurrences, counts, extensions, fuzzy candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions import units
from termloom.operators.dictionary import checked_broadcast


def contains(texts: DataFrame, pattern: str, column: str = "term") -> DataFrame:
    """One row: found; '' is found if there is a text."""
    return texts.agg(F.coalesce(F.bool_or(F.contains(column, F.lit(pattern))), F.lit(False)).alias("found"))


def ending_with(texts: DataFrame, pattern: str, column: str = "term") -> DataFrame:
    """Texts that end with the pattern (string_id, text_len): every one, copies included."""
    return texts.where(F.endswith(column, F.lit(pattern))).select("string_id", F.char_length(column).alias("text_len"))


def occurrences(terms: DataFrame, pattern: str, unit: str = "char") -> DataFrame:
    """term, pos of every occurrence, overlaps included; '' gives (term, 0) once per term."""
    if pattern == "":
        return terms.select("term", F.lit(0).alias("pos"))
    size = len(pattern.encode()) if unit == "byte" else len(pattern)
    wanted = F.lit(pattern.encode() if unit == "byte" else pattern)
    rows = terms.where(F.contains("term", F.lit(pattern)))
    last = units.length(F.col("term"), unit) - size
    starts = F.filter(F.sequence(F.lit(0), last), lambda i: units.slice_of(F.col("term"), i, size, unit) == wanted)
    return rows.select("term", F.explode(starts).alias("pos"))


def frequency(terms: DataFrame, pattern: str, unit: str = "char") -> DataFrame:
    """One row: freq, the number of occurrences; of '' one more than the length of each term."""
    if pattern == "":
        return terms.agg(F.coalesce(F.sum(units.length(F.col("term"), unit) + 1), F.lit(0)).cast("long").alias("freq"))
    return occurrences(terms, pattern, unit).agg(F.count(F.lit(1)).alias("freq"))


def match_count(terms: DataFrame, pattern: str, unit: str = "char") -> DataFrame:
    """One row: n_matches, the number of rows of occurrences()."""
    return occurrences(terms, pattern, unit).agg(F.count(F.lit(1)).alias("n_matches"))


def limited(terms: DataFrame, pattern: str, n: int, unit: str = "char") -> DataFrame:
    """The first n occurrences by term and position."""
    return occurrences(terms, pattern, unit).orderBy("term", "pos").limit(n)


def contexts(found: DataFrame, pattern: str) -> DataFrame:
    """Occurrences (term, pos in code points) with the matched part and what stands around it."""
    n = len(pattern)
    return found.select(
        "term",
        "pos",
        F.substring("term", F.col("pos") + 1, F.lit(n)).alias("matched"),
        F.substring("term", F.lit(1), F.col("pos")).alias("before"),
        F.substring("term", F.col("pos") + 1 + n, F.char_length("term")).alias("after"),
        F.col("pos").alias("left_len"),
        (F.char_length("term") - F.col("pos") - n).alias("right_len"),
    )


def extensions(terms: DataFrame, pattern: str, side: str = "left") -> DataFrame:
    """label, n: the characters that stand before (or behind) the pattern's occurrences."""
    place = F.col("pos") if side == "left" else F.col("pos") + 1 + len(pattern)
    out = occurrences(terms, pattern).withColumn("label", F.when(place >= 1, F.substring("term", F.greatest(place, F.lit(1)), F.lit(1))))
    return out.where("label IS NOT NULL AND label != ''").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def grams(terms: DataFrame, k: int) -> DataFrame:
    """gram, term, pos of every k-gram of code points."""
    n = F.char_length("term") - k
    starts = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    return terms.select("term", F.explode(starts).alias("pos")).withColumn("gram", F.substring("term", F.col("pos") + 1, F.lit(k)))


def occurrences_of_many(terms: DataFrame, patterns: DataFrame, k: int = 3) -> DataFrame:
    """pattern, term, pos for a table of patterns: joined on the pattern's first k-gram, then verified.

    Patterns below k code points are met by grams of their own length; '' is met by none.
    """
    lengths = [r[0] for r in patterns.where("pattern != ''").select(F.least(F.char_length("pattern"), F.lit(k)).alias("n")).distinct().orderBy("n").collect()]
    out = None
    for n in lengths:
        own = patterns.where(F.least(F.char_length("pattern"), F.lit(k)) == n).select("pattern", F.substring("pattern", 1, n).alias("gram")).distinct()
        met = grams(terms, n).join(checked_broadcast(own), "gram").where(F.substring("term", F.col("pos") + 1, F.char_length("pattern")) == F.col("pattern"))
        met = met.select("pattern", "term", "pos")
        out = met if out is None else out.union(met)
    return terms.sparkSession.createDataFrame([], "pattern string, term string, pos int") if out is None else out


def pieces(query: Column, budget: Column) -> Column:
    """The query in budget + 1 pieces of widths that differ by one at most, wider ones first."""
    n = budget + 1
    base, extra = F.floor(F.char_length(query) / n).cast("int"), F.char_length(query) % n

    def piece(i: Column) -> Column:
        start = i * base + F.least(i, extra)
        return F.struct(i.alias("piece_no"), F.substring(query, start + 1, base + F.when(i < extra, 1).otherwise(0)).alias("piece"))

    return F.transform(F.sequence(F.lit(0), budget), piece)


def fuzzy(terms: DataFrame, queries: DataFrame, k: int = 2) -> DataFrame:
    """query, term, distance of terms within the query's budget (Levenshtein, code points).

    Whatever is within the budget contains a piece of the query, so pieces are the candidates' join key:
    by k-grams where pieces are that long, else by the pieces themselves. Queries no longer than their
    budget have no such pieces and are joined with the terms on length. queries: query, budget.
    """
    cut = queries.where(F.char_length("query") > F.col("budget")).select("query", "budget", F.explode(pieces(F.col("query"), F.col("budget"))).alias("p"))
    cut = cut.select("query", "budget", F.col("p.piece").alias("pattern"))
    near = occurrences_of_many(terms, cut.select("pattern").distinct(), k).select("pattern", "term").distinct()
    pairs = cut.join(near, "pattern").select("query", "budget", "term").distinct()
    pairs = pairs.where(F.abs(F.char_length("query") - F.char_length("term")) <= F.col("budget"))
    short = queries.where(F.char_length("query") <= F.col("budget"))
    short = short.select("query", "budget", F.explode(F.sequence(F.lit(0), F.char_length("query") + F.col("budget"))).alias("_n"))
    pairs = pairs.union(short.join(terms.select("term").distinct(), F.col("_n") == F.char_length("term")).select("query", "budget", "term").distinct())
    return pairs.withColumn("distance", F.levenshtein("query", "term")).where("distance <= budget").select("query", "term", "distance")


def _size_limit(longest: int | None) -> Column:
    left = F.char_length("term") - F.col("i") + 1
    return left if longest is None else F.least(F.lit(longest), left)


def distinct_substrings(terms: DataFrame, longest: int | None = None) -> DataFrame:
    """Every distinct substring (quadratic in the length), or those of at most longest code points."""
    n = F.char_length("term")
    starts = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    rows = terms.select("term", F.explode(starts).alias("i"))
    sizes = F.sequence(F.lit(1), _size_limit(longest))
    return rows.select("term", "i", F.explode(sizes).alias("m")).select(F.substring("term", F.col("i"), F.col("m")).alias("substring")).distinct()


def endpos_classes(terms: DataFrame, longest: int | None = None) -> DataFrame:
    """end_set (digest), n_substrings, shortest, longest: substrings that end at the same places."""
    n = F.char_length("term")
    starts = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    rows = terms.select("term", F.explode(starts).alias("i"))
    rows = rows.select("term", "i", F.explode(F.sequence(F.lit(1), _size_limit(longest))).alias("m"))
    rows = rows.select(F.substring("term", F.col("i"), F.col("m")).alias("s"), F.struct("term", (F.col("i") + F.col("m")).alias("end")).alias("e"))
    ends = rows.groupBy("s").agg(F.sha2(F.to_json(F.array_sort(F.collect_set("e"))), 256).alias("end_set"))
    return ends.groupBy("end_set").agg(F.count(F.lit(1)).alias("n_substrings"), F.min(F.char_length("s")).alias("shortest"), F.max(F.char_length("s")).alias("longest"))
