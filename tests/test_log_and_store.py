import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.operators import oplog
from termloom.sources import formats, shared
from termloom.sources.store import Store
from termloom.streaming import replay

OPS = "term string, op string, value bigint, delta bigint, generation bigint, lsn bigint"
FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def replayed(ops, base=()):
    state = dict(base)
    for term, op, value, delta, _, _ in sorted(ops, key=lambda o: (o[4], o[5])):
        if op == "remove":
            state.pop(term, None)
        elif op == "upsert":
            state[term] = value
        elif op == "delta":
            state[term] = (state.get(term) or 0) + delta
        elif state.get(term) is None:
            state[term] = value
    return state


op = st.tuples(st.sampled_from("xy"), st.sampled_from(["insert", "upsert", "remove", "delta"]), st.one_of(st.none(), st.integers(0, 9)), st.integers(-3, 3), st.integers(0, 3))


@FEW
@given(st.lists(op, min_size=1, max_size=12), st.dictionaries(st.sampled_from("xz"), st.one_of(st.none(), st.integers(0, 9))))
def test_reconcile_is_the_fold(spark, ops, base):
    ops = [(t, o, v if o in ("insert", "upsert") else None, d if o == "delta" else None, g, i) for i, (t, o, v, d, g) in enumerate(ops)]
    df = spark.createDataFrame(ops, OPS)
    got = lambda d: {r["term"]: r["value"] for r in d.collect()}
    assert got(oplog.reconcile(df)) == replayed(ops) == got(oplog.folded(df))
    assert got(oplog.reconcile(df, spark.createDataFrame(list(base.items()), "term string, value bigint"))) == replayed(ops, base)


def record(lsn, kind, term=None, value=None, **more):
    names = [c.split()[0] for c in oplog.SCHEMA.split(", ")]
    return tuple({"lsn": lsn, "kind": kind, "term": term, "value": value, **more}.get(n) for n in names)


def log(spark, *records):
    return spark.createDataFrame(list(records), oplog.SCHEMA)


def test_records(spark):
    df = log(spark, record(1, "batch_insert", entries=[("a", 1, None), ("b", None, None)]), record(2, "swap", "a", 5, success=False), record(3, "increment", "c", delta=2, result=9), record(4, "checkpoint", checkpoint_lsn=3))
    assert [(r["lsn"], r["op"], r["term"], r["value"]) for r in oplog.operations(df).orderBy("lsn", "n").collect()] == [(1, "insert", "a", 1), (1, "insert", "b", None), (3, "upsert", "c", 9)]


def test_ranks_and_regimes(spark):
    df = log(spark, record(1, "upsert", "a", 1), record(2, "remove", "a"), record(3, "commit_rank", data_lsn=1, generation=9), record(4, "commit_rank", data_lsn=2, generation=8), record(5, "upsert", "b", 1))
    ops = oplog.operations(df)
    assert {r["term"]: r["value"] for r in oplog.reconcile(oplog.ranked(df, ops, True)).collect()} == {"a": 1}
    assert {r["term"]: r["value"] for r in oplog.reconcile(oplog.ranked(df, ops, False)).collect()} == {"a": 1, "b": 1}


def test_watermark(spark):
    of = lambda *x: oplog.committed_watermark(spark.createDataFrame([(i,) for i in x], "lsn bigint")).first()[0]
    assert of(1, 2, 4) == 2
    assert of(2, 3) == 0
    assert of(1) == 1


def test_store(spark):
    path = shared.fresh(spark, "test-store")
    store = Store.create(spark, path)
    with pytest.raises(FileExistsError):
        Store.create(spark, path)
    store.append(log(spark, record(1, "upsert", "a", 1), record(2, "upsert", "b", 2)))
    assert store.stats()["is_dirty"]
    store.checkpoint()
    store.append(log(spark, record(3, "remove", "a"), record(4, "upsert", "c", 3), record(5, "upsert", "bad", 0)))
    spark.range(1).write.parquet(f"{path}/v=99")  # a writer that died
    again, report = Store.open_with_recovery(spark, path, bad=F.col("term") == "bad")
    assert report == {"mode": "repaired", "stray_versions": 1, "from_lsn": 2, "to_lsn": 4}
    assert {r["term"]: r["value"] for r in again.read().collect()} == {"b": 2, "c": 3}
    again.compact()
    assert again.prune_log() == 1
    assert Store.open(spark, path).read().count() == 2
    with pytest.raises(FileNotFoundError):
        Store.open(spark, path + "-none")


def test_stream_is_idempotent(spark):
    store = Store.create(spark, shared.fresh(spark, "test-stream"))
    batch = log(spark, record(1, "batch_increment", entries=[("a", None, 2)]))
    assert replay.apply_batch(store, batch, 0)
    assert not replay.apply_batch(store, batch, 0)
    assert store.read().first()["value"] == 2


def test_formats(spark, tmp_path):
    terms = spark.createDataFrame([("", 1), ("a b", 2), ("日本\t", None), ("x", -5)], "term string, value bigint")
    formats.write_lines(terms, str(tmp_path / "lines"), "gzip")
    assert sorted(r[0] for r in formats.read_lines(spark, str(tmp_path / "lines")).collect()) == ["a b", "x", "日本\t"]
    formats.write_tsv(terms.where("term != ''"), str(tmp_path / "tsv"))
    assert sorted(map(tuple, formats.read_tsv(spark, str(tmp_path / "tsv")).collect())) == [("a b", 2), ("x", -5)]
    formats.write_json(terms, str(tmp_path / "json"))
    assert formats.read_json(spark, str(tmp_path / "json")).exceptAll(terms).isEmpty()
    for packed in (False, True):
        formats.write_graph(terms, str(tmp_path / f"graph{packed}"), packed)
        assert sorted(r[0] for r in formats.read_graph(spark, str(tmp_path / f"graph{packed}"), packed).collect()) == sorted(["", "a b", "x", "日本\t"])
    spark.createDataFrame([("no tab",)], "value string").write.text(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="no tab"):
        formats.read_tsv(spark, str(tmp_path / "bad")).collect()
    with pytest.raises(Exception, match="line break"):
        formats.write_lines(spark.createDataFrame([("a\nb",)], "term string"), str(tmp_path / "broken"))


def test_versions_without_a_manifest_stay(spark):
    path = shared.fresh(spark, "test-store")
    store = Store.create(spark, path, overlay=True)
    store.publish(spark.createDataFrame([("a", 1)], "term string, value bigint"))
    names = [n for n in shared.names(spark, path) if n.startswith("manifest-")]
    assert len(names) == 1
    shared.delete(spark, f"{path}/{names[0]}")
    with pytest.raises(FileNotFoundError, match="no manifest"):
        Store.open_with_recovery(spark, path)
    assert "v=1" in shared.names(spark, path)
