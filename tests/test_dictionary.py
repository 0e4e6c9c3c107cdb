from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.functions import units
from termloom.operators import counters, setops, structure, substring, vocab
from termloom.operators.dictionary import Dictionary

TERMS = ["", "s", "sun", "sunny", "山", "山火事", "tea🍵pot", "low tide"]
FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture
def terms(spark):
    return spark.createDataFrame([(t, i if i % 3 else None) for i, t in enumerate(TERMS)], "term string, value bigint")


def listed(df):
    return sorted(r[0] for r in df.collect())


def test_prefixes(spark, terms):
    d = Dictionary(terms)
    assert listed(d.with_prefix("sun").df) == ["sun", "sunny"]
    assert listed(d.with_prefix("").df) == sorted(TERMS)
    assert listed(d.excluding("").df) == []
    assert listed(d.excluding("sun", "山").df) == ["", "low tide", "s", "tea🍵pot"]
    many = spark.createDataFrame([("sun",), ("山",), ("zz",)], "prefix string")
    assert listed(d.with_any_prefix(many).df) == ["sun", "sunny", "山", "山火事"]
    assert listed(d.excluding_any(many).df) == ["", "low tide", "s", "tea🍵pot"]
    assert "NestedLoop" not in plan(d.with_any_prefix(many).df)
    assert [r["term"] for r in d.page_after("s", 2).collect()] == ["sun", "sunny"]
    assert {(r["label"], r["is_final"]) for r in d.children("sun").collect()} == {("n", False)}


def test_prefix_reaches_the_scan(spark, tmp_path, terms):
    terms.write.parquet(str(tmp_path / "t"))
    assert "StringStartsWith(term,sun)" in plan(Dictionary(spark.read.parquet(str(tmp_path / "t"))).with_prefix("sun").df)


def test_null_values_are_members(spark, terms):
    d = Dictionary(terms)
    probes = spark.createDataFrame([("sun",), ("sunny",), ("zz",)], "term string")
    assert {tuple(r) for r in d.contains(probes).select("term", "found").collect()} == {("sun", True), ("sunny", True), ("zz", False)}
    assert "" not in listed(d.valued_members().df)
    up = d.upsert(spark.createDataFrame([("sun", None), ("new", None)], "term string, value bigint"))
    assert {r["term"]: r["value"] for r in up.df.collect()}["sun"] is None
    assert "new" in listed(up.df)


def test_units(spark):
    df = spark.createDataFrame([("日本語",)], "term string")
    assert df.select(units.length(F.col("term"), "byte")).first()[0] == 9
    assert df.select(units.slice_of(F.col("term"), 1, 1, "char")).first()[0] == "本"
    assert df.select(units.pack_u64(F.lit("\x01\x00abcdefgh"))).first()[0][0] == int.from_bytes(b"\x01\x00abcdef", "little")
    doubles = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),)], "x double")
    assert doubles.select(units.bits_of_double(F.col("x")).alias("k")).distinct().count() == 3


@FEW
@given(st.lists(st.text("ab日", max_size=6), min_size=1, max_size=6, unique=True), st.text("ab日", min_size=1, max_size=2))
def test_occurrences_brute_force(spark, words, pattern):
    df = spark.createDataFrame([(w,) for w in words], "term string")
    want = sorted((w, i) for w in words for i in range(len(w)) if w.startswith(pattern, i))
    assert sorted(map(tuple, substring.occurrences(df, pattern).collect())) == want
    raw = sorted((w, i) for w in words for i in range(len(w.encode())) if w.encode().startswith(pattern.encode(), i))
    assert sorted(map(tuple, substring.occurrences(df, pattern, "byte").collect())) == raw
    many = substring.occurrences_of_many(df, spark.createDataFrame([(pattern,)], "pattern string"), 2)
    assert sorted((r["term"], r["pos"]) for r in many.collect()) == want
    assert substring.frequency(df, "").first()[0] == sum(len(w) + 1 for w in words)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@FEW
@given(st.lists(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=8, unique=True), st.text("abc", min_size=3, max_size=6))
def test_fuzzy_brute_force(spark, words, query):
    df = spark.createDataFrame([(w,) for w in words], "term string")
    found = substring.fuzzy(df, spark.createDataFrame([(query, 2)], "query string, budget int"))
    assert sorted((r["term"], r["distance"]) for r in found.collect()) == sorted((w, distance(query, w)) for w in words if distance(query, w) <= 2)


@FEW
@given(st.lists(st.dictionaries(st.text("abc", max_size=2), st.integers(0, 9), max_size=5), min_size=2, max_size=3))
def test_set_algebra_brute_force(spark, dicts):
    rows = [(i, t, v) for i, d in enumerate(dicts) for t, v in d.items()]
    tags = spark.createDataFrame(rows, "dict_idx int, term string, value bigint")
    of = defaultdict(list)
    for _, t, v in rows:
        of[t].append(v)
    values = lambda df: {r["term"]: r["value"] for r in df.collect()}
    assert values(setops.union_valued(tags, setops.first_wins)) == {t: v[0] for t, v in of.items()}
    assert values(setops.union_valued(tags, setops.last_wins)) == {t: v[-1] for t, v in of.items()}

    def fold(v):
        out = v[0]
        for x in v[1:]:
            out = out * 3 - x
        return out

    assert values(setops.union_valued(tags, setops.folded(lambda a, b: a * 3 - b))) == {t: fold(v) for t, v in of.items()}
    assert values(setops.intersection_valued(tags, len(dicts))) == {t: min(v) for t, v in of.items() if len(v) == len(dicts)}
    assert values(setops.symmetric_difference(tags)) == {t: v[0] for t, v in of.items() if len(v) == 1}


def test_counters(spark):
    base = spark.createDataFrame([("x", 2**63 - 1)], "term string, value bigint")
    with pytest.raises(Exception, match="out of range"):
        counters.increment(base, spark.createDataFrame([("x", 1)], "term string, delta bigint")).collect()
    big = counters.increment(base, spark.createDataFrame([("x", 1)], "term string, delta bigint"), "u64").first()[1]
    assert int(big) == 2**63
    log = spark.createDataFrame([("h", i, 1) for i in range(50)], "term string, seq bigint, delta bigint")
    assert all(r["value_after"] == r["seq"] + 1 for r in counters.fetch_add(log, span=7).collect())


def test_automaton_counts(spark):
    df = spark.createDataFrame([("cat",), ("bat",)], "term string")
    assert structure.trie_nodes(df).count() == 7
    assert structure.dawg_states(df).count() == 4  # root, one state behind c and b, "t", the end


def test_vocabulary(spark):
    seen = spark.createDataFrame([("b", 2), ("a", 3), ("b", 1)], "term string, first_seen bigint")
    assert {tuple(r) for r in vocab.assign(None, seen).collect()} == {("b", 0), ("a", 1)}
    bad = vocab.bijection_conflicts(spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 3)], "term string, value bigint"))
    assert {tuple(r) for r in bad.collect()} == {("a", 1, "duplicate_term"), ("a", 2, "duplicate_term"), ("b", 2, "duplicate_value")}


def test_prefixes_of_bytes_and_numbers(spark):
    d = Dictionary(spark.createDataFrame([("山火事",), ("山",), ("sun",)], "term string"), "byte")
    assert listed(d.with_any_prefix(spark.createDataFrame([("山",)], "prefix string")).df) == ["山", "山火事"]
    assert {(bytes(r["label"]), r["is_final"]) for r in d.children("山").collect()} == {("火".encode()[:1], False)}
    rows = [([1, 2, 3], 1), ([1, 2], 2), ([9], 3), ([2**63 + 5, 7], 4)]
    n = Dictionary(spark.createDataFrame([([__import__("decimal").Decimal(x) for x in seq], v) for seq, v in rows], "term array<decimal(20,0)>, value bigint"), "u64")
    heads = spark.createDataFrame([([__import__("decimal").Decimal(x)],) for x in (1, 2**63 + 5)], "prefix array<decimal(20,0)>")
    assert sorted(r["value"] for r in n.with_any_prefix(heads).df.collect()) == [1, 2, 4]
    assert {(int(r["label"][0]), r["is_final"]) for r in n.children([1]).collect()} == {(2, True)}
    assert [r["value"] for r in n.page_after([1, 2], 2).collect()] == [1, 3]


def test_meet_of_nothing_is_null(spark):
    tags = spark.createDataFrame([(i, t, None) for i in (0, 1) for t in ("x", "y")], "dict_idx int, term string, value array<int>")
    assert {r["value"] for r in setops.intersection_valued(tags, 2, setops.meet_sets).collect()} == {None}
    assert {r["value"] for r in setops.intersection_valued(tags, 2, setops.folded(lambda a, b: a)).collect()} == {None}
