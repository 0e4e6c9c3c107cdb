from termloom.operators import substring


def test_short_queries_meet_short_terms(spark):
    terms = spark.createDataFrame([("a",), ("ab",), ("abcd",), ("xyzuv",), ("",)], "term string")
    queries = spark.createDataFrame([("ab", 2), ("", 1)], "query string, budget int")
    found = {(r["query"], r["term"], r["distance"]) for r in substring.fuzzy(terms, queries).collect()}
    assert found == {("ab", "a", 1), ("ab", "ab", 0), ("ab", "abcd", 2), ("ab", "", 2), ("", "a", 1), ("", "", 0)}


def test_substrings_of_any_length(spark):
    terms = spark.createDataFrame([("abcdefgh",)], "term string")
    assert substring.distinct_substrings(terms).count() == 36
    rows = substring.endpos_classes(terms).collect()
    assert sum(r["n_substrings"] for r in rows) == 36 and max(r["longest"] for r in rows) == 8
