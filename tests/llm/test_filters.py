import glob
import os
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from termloom.llm import catalog, decontaminate, html_text, language_id, license_scan, mixing, quality_rules, token_output
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.ORACLES))
@pytest.mark.parametrize("small", [True, False])
def test_sql(spark, same, sf_dir, name, small):
    con, folder = duckdb.connect(), sf_dir if small else SF
    path = f"{folder}/documents.parquet"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet' )" if os.path.isdir(path) else f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}')")
    same(catalog.QUERIES[name](spark, folder).toPandas(), con.execute(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", ["op1_license_scan", "op2_decontaminate", "op4_token_output", "op6_language_id", "op7_mixing", "op9_html_text", "op10_quality_rules"])
def test_empty_and_clashing(spark, empty_sf, clashing_sf, name):
    assert catalog.QUERIES[name](spark, empty_sf).count() == 0
    if name != "op9_html_text":
        catalog.QUERIES[name](spark, clashing_sf).collect()


def test_cascade_order_changes_nothing(spark, docs):
    orders = list(quality_rules.RULES), list(quality_rules.RULES)[::-1]
    a, b = (sorted((r["doc_id"], r["kept"]) for r in quality_rules.judged(docs, order=o).select("doc_id", "kept").collect()) for o in orders)
    assert a == b


def test_rule_stage_keeps_columns(spark, docs, sf_dir):
    assert quality_rules.stage(spark, docs, sf_dir).columns == docs.columns


def test_rule_stage_keeps_clean_texts(spark, sf_dir):
    r = random.Random(3)
    vocab = ["".join(r.choice("aeioubdklmnrst") for _ in range(6)) for _ in range(1500)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    clean = [(1, f"{prose(80)}\nread more\nread more"), (2, prose(20_000))]
    bad = [(3, "\n".join([prose(40)] + ["click here to read the whole of the story"] * 20)), (4, " ".join(r.choice(vocab[:9]) for _ in range(4000)))]
    docs = spark.createDataFrame(clean + bad, "doc_id bigint, text string")
    assert sorted(x["doc_id"] for x in quality_rules.stage(spark, docs, sf_dir).collect()) == [1, 2]
    names = ["duplicate_lines", "few_distinct_words"]
    rows = quality_rules.prepared(docs).select("doc_id", *[F.expr(quality_rules.STAGE_RULES[n]).alias(n) for n in names]).collect()
    assert {n: [x["doc_id"] for x in rows if x[n]] for n in names} == {"duplicate_lines": [3], "few_distinct_words": [4]}


def test_mixture_meets_targets(spark, sf_dir, docs):
    rows = mixing.op7_mixing(spark, sf_dir).join(docs.select("doc_id", "source").distinct(), "doc_id").collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    mixed = mixing.mixed(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 1 for r in mixed)
    staged = mixing.stage(spark, docs, sf_dir)
    assert staged.columns == docs.columns
    assert sum(len(brute.words(r["text"])) for r in staged.collect()) >= sum(r["taken"] for r in mixed)


def test_tokens_round_trip(spark, sf_dir, texts):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    import zlib

    want = sorted((k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, t in texts for ids in [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]])
    found = sorted(token_output.op4_token_output(spark, sf_dir).collect(), key=lambda r: r["start"])
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == want
    at = 0
    for a, b in zip(found, found[1:] + [None]):
        assert a["start"] == at and (b is None or a["doc_id"] <= b["doc_id"])
        at += a["n_tokens"]


def test_language_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    rows = language_id.op6_language_id(spark, folder).join(truth, "doc_id").where("held_out AND lang IS NOT NULL AND n > 100").collect()
    assert len(rows) > 50
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_without_letters(spark):
    docs = spark.createDataFrame([(1, None, False), (2, "", False), (3, "12 3!", False), (4, "3\u0301 \u0300\u0301 7", False)], "doc_id bigint, text string, held_out boolean")
    assert {r["lang_pred"] for r in language_id.predicted(docs, {"en": np.array([101])}).collect()} == {"und"}


def test_licenses(spark):
    mit = license_scan.TEMPLATES["MIT"]
    rows = [(1, "code first. " + mit + " and more"), (2, mit.replace("publish, distribute,", "").upper()), (3, "nothing here to see"), (4, None), (5, "")]
    found = license_scan.scanned(spark.createDataFrame(rows, "doc_id bigint, text string")).where("template = 'MIT'").collect()
    by = {r["doc_id"]: r for r in found}
    assert set(by) == {1, 2} and by[1]["coverage"] == 1.0 and 0.9 < by[2]["coverage"] < 1
    assert rows[0][1][by[1]["span_start"] : by[1]["span_end"]] == mit.rstrip(".")


def test_whole_licenses_siblings_and_insertions():
    index = license_scan.Index(license_scan.TEMPLATES)
    found = lambda text: {m[0]: m for m in license_scan.scan(text, index)}
    for name, end in (("MIT", "DEALINGS IN THE SOFTWARE"), ("ISC", "PERFORMANCE OF THIS SOFTWARE"), ("BSD-3-Clause", "POSSIBILITY OF SUCH DAMAGE"), ("BSD-2-Clause", "POSSIBILITY OF SUCH DAMAGE")):
        text = license_scan.TEMPLATES[name]
        got = found(f"some code {text} more code")
        assert got[name][3] == 1.0 and f"some code {text}"[got[name][4] : got[name][5]].endswith(end)
        assert len({"BSD-2-Clause", "BSD-3-Clause"} & set(got)) == name.startswith("BSD")
        part = text[text.index("THE SOFTWARE IS") if "BSD" not in name else text.index("THIS SOFTWARE IS") :]
        assert f"{name.split('-')[0]} warranty" in found(part)
        words = text.split()
        torn = " ".join(words[: len(words) // 2] + [f"inserted{i}" for i in range(60)] + words[len(words) // 2 :])
        assert found(torn)[name][3] == 1.0
    for name in ("LGPL-3.0", "AGPL-3.0", "GPL-3.0", "EPL-2.0"):
        assert {n for n in found(license_scan.TEMPLATES[name]) if n in {"LGPL-3.0", "AGPL-3.0", "GPL-3.0", "EPL-2.0"}} == {name}
    two = found(license_scan.TEMPLATES["MIT"] + " and " + license_scan.TEMPLATES["MIT"])
    assert sum(m[0] == "MIT" for m in license_scan.scan(license_scan.TEMPLATES["MIT"] + " and " + license_scan.TEMPLATES["MIT"], index)) == 2 and two["MIT"][3] == 1.0


def test_alignment_is_the_longest_common_subsequence():
    a, b = "a b c d e f g".split(), "x a b q c e f g".split()
    assert license_scan.aligned(a, b, 1)[0] == 6


def test_decontamination(spark):
    item = "How many apples does the farmer carry home when each of 12 baskets holds 7 kg of fresh red fruit picked today"
    other = item.replace("12", "95").replace("7 kg", "3 kg")
    torn = "Then " + item.replace("12", "44") + " they said"
    docs = spark.createDataFrame([(1, f"Start. {item} End."), (2, f"Start {other} end"), (3, "an unrelated text about the weather and the sea " * 5), (4, None), (5, ""), (6, torn)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(9, item), (10, None), (11, "")], "item_id bigint, text string")
    for limit in (0, 10**6):
        found = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontaminate.contaminated(docs, bench, broadcast_windows=limit).collect()}
        assert set(found) == {(1, 9), (2, 9), (6, 9)} and not found[1, 9] and found[2, 9]


def test_inconsistent_slots_are_no_match(spark):
    item = "if a train leaves at 5 and returns at 5 then how long was it away from home"
    docs = spark.createDataFrame([(1, item.replace("at 5 and", "at 8 and")), (2, item.replace("5", "8"))], "doc_id bigint, text string")
    found = decontaminate.contaminated(docs, spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert {r["doc_id"] for r in found.collect()} == {2}


def test_literal_copies_match_in_any_case_and_wrapping(spark):
    item = "How many apples does the farmer Anna Schmidt carry home when each of 12 baskets holds 7 kg of fresh red fruit from the Straße today"
    rows = [(1, item.upper()), (2, item.title()), (3, item.replace(" ", "\n")), (4, item.replace("12", "40").upper()), (5, item.replace(" Anna", "\nClara"))]
    docs = spark.createDataFrame([(k, f"so they ask. {t} and so on") for k, t in rows], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    for limit in (0, 10**6):
        found = {r["doc_id"]: r for r in decontaminate.contaminated(docs, bench, broadcast_windows=limit).collect()}
        assert set(found) == {1, 2, 3, 4, 5} and all(r["coverage"] == 1.0 for r in found.values())


def test_slots_spoil_no_more_than_their_run(spark):
    twice = "a shop sells 12 pens on every day of the week and the clerk who writes the sales down in a long book says that by the end of a month there are 12 left on the shelf behind the door"
    two = "each of 12 baskets in the old barn holds exactly 7 apples and the farmer wants to know how many there are"
    sums = "12 + 7 = 19 and 3 + 4 = 7 so 19 + 7 = 26"
    rows = [(1, twice.replace("12 left", "15 left")), (2, two.replace("12", "9").replace("7", "9")), (3, sums), (4, twice.replace("12 pens", "31 pens").replace("a long", "one thick").replace("12 left", "40 left"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, twice), (2, two), (3, sums)], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(found) == {(1, 1), (2, 2), (3, 3), (4, 1)}
    assert found[2, 2]["coverage"] == found[3, 3]["coverage"] == 1.0 and found[1, 1]["matched"] < found[1, 1]["item_windows"]


def test_pages(spark, sf_of):
    story = "The river rose through the night and by morning the lower fields were under water as far as the mill road."
    html = f"<html><body><nav><a href='/'>Home</a> <a href='/x'>News</a></nav><article><h1>Flood</h1><p>{story} It&rsquo;s   over.</p><p>{story}</p></article><footer>Copyright</footer><script>var x=1</script></body></html>"
    made = spark.createDataFrame([(1, "u", html), (2, "v", None), (3, "w", ""), (4, "x", "<p>open <b>only")], "page_id bigint, url string, html string")
    real = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    forest = html_text.fit(real)
    rows = {r["page_id"]: r for r in html_text.extracted(made, forest).collect()}
    assert rows[2]["text"] == "" and rows[3]["text"] == ""
    assert story + " It’s over." in rows[1]["text"] and "Copyright" not in rows[1]["text"] and "var x" not in rows[1]["text"] and "News" not in rows[1]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values())


def test_registered(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names and glob.glob(f"{SF}/*.parquet")


def test_cascade_order_is_the_same_again_and_short_circuits(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = (quality_rules.estimated_order(d, quality_rules.RULES) for d in (df, df.repartition(7)))
    assert a == b and {r["name"] for r in a} == set(quality_rules.RULES)
    assert [r["reached"] for r in a] == sorted((r["reached"] for r in a), reverse=True)
    assert a[0]["rejected"] > 0 and all(x["reached"] - round(x["rejected"] * x["reached"]) == y["reached"] for x, y in zip(a, a[1:], strict=False))
    ask = {"first": "n_words > 0", "never": "cast(raise_error('asked') as boolean)"}
    out = quality_rules.judged(df.where("text IS NOT NULL"), ask, ["first", "never"])
    assert {r[0] for r in out.select("rejected_by").distinct().collect()} <= {"base", "first"}
