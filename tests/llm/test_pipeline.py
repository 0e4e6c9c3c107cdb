from pyspark.sql import functions as F

import corpus_pipeline
from termloom.llm import near_dedup, quality_rules
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).cache()
        kept[name] = docs.count()
        if name != "token_output":
            assert docs.columns == columns
        if name in ("quality_rules", "near_dedup", "decontaminate"):
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).isEmpty()
        if name == "near_dedup":
            rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
            want = {k for k, _, c in brute.near(rows, 5, 80) if k == c}
            assert {r[0] for r in docs.select("doc_id").collect()} == want
        if name == "mixing":
            n_rows = kept[name]
    assert kept["token_output"] == n_rows
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "mixing", "token_output"]


def test_clean_documents_stay(spark, docs, sf_dir):
    kept = {r[0] for r in quality_rules.stage(spark, docs, sf_dir).select("doc_id").collect()}
    assert {k for k in range(40)} - {r["doc_id"] for r in docs.collect() if len(brute.words(r["text"])) < 50} <= kept


def test_chunks_find_what_pairs_find(spark):
    import random

    r = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(90):
        w = list(base)
        for at in r.sample(range(150), r.choice([1, 3, 5, 7])):
            w[at] = f"x{k}_{at}"
        rows.append((k, " ".join(w)))
    out = near_dedup.linked_components(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, out.collect())) == sorted(brute.near(rows))


def test_storing_a_table_leaves_no_shuffle_files(spark):
    import glob
    import time

    from termloom.llm.common import Scope, stored

    def files():
        return set(glob.glob(f"{spark.conf.get('spark.local.dir')}/**/shuffle_*", recursive=True))

    before = files()
    with Scope(spark):
        out = stored(spark.range(5000).groupBy(F.col("id") % 700).count(), "shuffled")
        time.sleep(1)  # they are deleted behind the query
        assert files() <= before
        assert out.count() == 700
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
