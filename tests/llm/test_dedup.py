import pytest

from termloom.llm import near_dedup, phrase_dedup, suffix_dedup
from tests.llm import brute


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_phrases(spark, sf_dir, texts):
    out = phrase_dedup.op3_phrase_dedup(spark, sf_dir)
    assert rows(out, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.phrase(texts), key=str)


def test_suffixes(spark, sf_dir, texts):
    out = suffix_dedup.op8_suffix_dedup(spark, sf_dir)
    assert rows(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.suffix(texts), key=str)


def test_hot_anchors_give_the_same(spark, docs, texts):
    copies = spark.createDataFrame([], "_key long, digests array<string>")
    want = {(k, r, s) for k, _, r, s, _ in brute.suffix(texts) if r}
    for hot_rows in (2, 2**62):
        out = suffix_dedup.removed_bytes(docs, copies, hot_rows=hot_rows)
        assert {tuple(r) for r in out.select("_key", "n_removed", "n_spans").collect() if r[1]} == want


def test_units_of_many_batches_are_packed_once_for_a_task(monkeypatch):
    parts = [[(1000 * i + j % 5, i, j, 10 * j, b"%d-%d" % (i, j) * (j + 1)) for j in range(30)] for i in range(40)]
    parts.insert(3, [])
    units = sorted(u for part in parts for u in part)
    for held, packings in ((2**30, 1), (1800, 40)):
        monkeypatch.setattr(suffix_dedup, "HELD_BYTES", held)
        found = list(suffix_dedup.packings(iter(parts), 7))
        assert len(found) == packings and all(f["task"].is_unique for f in found)
        rows = [r for f in found for r in f.itertuples(index=False)]
        out = []
        for t in {r.task for r in rows}:
            mine = [r for r in rows if r.task == t]
            out.append(suffix_dedup.unpacked([r.n for r in mine], [r.block for r in mine]))
        assert len({a for f in out for a in f["anchor"].unique()}) == sum(f["anchor"].nunique() for f in out)  # an anchor, a task
        assert sorted(u for f in out for u in f[suffix_dedup.UNIT].itertuples(index=False, name=None)) == units


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_copies(spark, docs, texts, k, percent):
    out = near_dedup.linked_components(docs, k, percent)
    assert rows(out, "doc_id", "n_shingles", "component_id") == sorted(brute.near(texts, k, percent), key=str)


def test_near_stage_keeps_one_of_each_group(spark, docs, texts, sf_dir):
    found = brute.near(texts, 5, 80)
    left = near_dedup.stage(spark, docs, sf_dir)
    assert left.columns == docs.columns
    assert {r[0] for r in left.select("doc_id").collect()} == {k for k, _, c in found if k == c}


def test_bounds_of_the_posterior():
    assert near_dedup.least_matches(20, 0.85, 1e-6) < near_dedup.least_matches(140, 0.85, 1e-6) < 0.85 * 140


@pytest.mark.parametrize("query", [phrase_dedup.op3_phrase_dedup, suffix_dedup.op8_suffix_dedup, near_dedup.op5_near_dedup])
def test_empty_and_clashing(spark, empty_sf, clashing_sf, sf_dir, query):
    assert query(spark, empty_sf).count() == 0
    out = query(spark, clashing_sf)
    assert rows(out, *out.columns) == rows(query(spark, sf_dir), *out.columns)


def test_rows_without_id_link_as_any_others(spark, docs):
    w = [f"word{i}" for i in range(60)]
    near = [" ".join(w), " ".join([*w[:-2], "x", "y"]), " ".join([*w[:-4], "p", "q", "x", "y"])]
    df = spark.createDataFrame([(1, near[0]), (None, near[1]), (3, near[2]), (None, "quite another text"), (5, near[0]), (5, "of its own")], "doc_id bigint, text string")
    out = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in near_dedup.linked_components(df).collect()}
    assert out == {(1, 58): 1, (None, 58): 1, (3, 58): 1, (None, 1): None, (5, 58): 1, (5, 1): 5}


def test_near_stage_judges_rows_by_their_text(spark, sf_dir):
    a, u, v = (" ".join(f"{c}{i}" for i in range(40)) for c in "auv")
    rows = [(1, a, 0), (None, a, 0), (None, u, 0), (7, v, 0), (7, v, 1), (1, u, 0), (8, None, 0), (8, "", 0), (8, "", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _row int")
    left = sorted(map(tuple, near_dedup.stage(spark, df, sf_dir).select("doc_id", "text").collect()), key=str)
    assert left == sorted([(1, a), (1, u), (7, v), (8, None), (8, ""), (8, "")], key=str)


def test_blocks_find_what_leaders_miss(spark):
    """Two groups whose members share bands but no leader, and a chain between them."""
    import random

    r = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(60):
        w = list(base)
        for i in r.sample(range(300), 9):
            w[i] = f"n{r.random()}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = near_dedup.linked_components(docs)
    assert rows(out, "doc_id", "n_shingles", "component_id") == sorted(brute.near(list(enumerate(texts)), 3, 85), key=str)
