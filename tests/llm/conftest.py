import random

import pytest

VOCAB = [a + b + c for a in "bdkmrst" for b in "aeiou" for c in ("n", "r", "la", "to")]


@pytest.fixture(scope="session")
def texts():
    """Rows (doc_id, text): prose, shared passages, exact and near copies, null, blank, repeated and short rows."""
    r = random.Random(5)
    prose = lambda n: " ".join(r.choice(VOCAB) for _ in range(n))
    passage = prose(60)
    rows = [(i, prose(r.randint(20, 160))) for i in range(40)]
    rows += [(40 + i, f"{prose(15)} {passage} {prose(10)}") for i in range(12)]
    rows += [(60 + i, rows[3][1]) for i in range(4)]
    for i in range(8):
        w = prose(120).split() if i == 0 else list(w)  # noqa: F821
        rows.append((70 + i, " ".join(w)))
        w[10 * i] = f"changed{i}"
    rows += [(80, None), (81, ""), (82, " \n\t "), (83, "one"), (84, "one"), (85, "Two words"), (86, "two WORDS"), (87, "été 日本語 " * 40), (88, "x " * 3000), (89, passage), (89, passage)]
    rows += [(90, "a\n" + passage.replace(" ", "\n")), (91, rows[0][1] + " " + rows[0][1])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    from tests.llm.brute import SCHEMA

    rows = [(k, t, ("de", "en", None)[k % 3], ("hot", "hot", "b", None)[k % 4], None if t is None else len(t)) for k, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def sf_of(tmp_path_factory):
    """Writes DataFrames as the tables of a folder that queries read."""

    def write(**tables):
        folder = str(tmp_path_factory.mktemp("sf"))
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}.parquet")
        return folder

    return write


@pytest.fixture(scope="session")
def sf_dir(sf_of, docs, spark):
    items = [(1, "How many apples does Anna Schmidt carry home if each of 12 baskets holds 7 kg of fresh red fruit today"), (2, "short item"), (3, None)]
    return sf_of(documents=docs, benchmark=spark.createDataFrame(items, "item_id bigint, text string"))


@pytest.fixture(scope="session")
def empty_sf(sf_of, docs, spark):
    return sf_of(
        documents=docs.limit(0),
        benchmark=spark.createDataFrame([], "item_id bigint, text string"),
        pages=spark.createDataFrame([], "page_id bigint, url string, html string"),
    )


@pytest.fixture(scope="session")
def clashing_sf(sf_of, docs, spark):
    """The documents with columns named as the operators name theirs."""
    more = docs
    for name in ("_key", "rk", "size", "key", "hits", "_words", "n_words", "label", "block", "kept", "_row", "target", "_th", "start", "digest", "sig"):
        more = more.withColumn(name, more["doc_id"])
    return sf_of(documents=more, benchmark=spark.createDataFrame([(1, "q")], "item_id bigint, text string"))
