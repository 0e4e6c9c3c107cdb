"""Decontamination against a row-by-row version, and what the first round's probes asked."""

import random
import re

from termloom.llm import decontaminate

UNITS = re.compile(rf"<num>(\s?)(?:{decontaminate.UNITS})(?=\s|$)")


def forms(text):
    """The words of a text plain, without numbers and units, and without names too."""

    def plain(t):
        words = []
        for w in t.split():
            end = w.rstrip(".,;:!?)\"']") or w[0]
            words.append((end.lstrip("\"'([") or end[-1]).lower())
        return " ".join(words)

    def unnumbered(t):
        t = re.sub(r"(?:(?<=^)|(?<=[\s(\[]))[$€£+-]?\d[\d.,:/%-]*", "<num>", t)
        return UNITS.sub(r"<num>\1<unit>", t)

    named = re.sub(r"(?<=[^.!?:\s] )[A-Z][A-Za-z'-]*", "<name>", re.sub(r"\s+", " ", text))
    return [x.split() for x in (plain(text), unnumbered(plain(text)), unnumbered(plain(named)))]


def test_forms_are_those_of_the_row_by_row_version(spark):
    r = random.Random(11)
    vocab = ["the", "Anna", "(Berlin)", "5", "5kg", "12", "kg", "km.", "$3.50", "end.", '"so', "...", "it's", "O'Neil,", "x-ray", "7%", "and", "['quote']", "A1", "(", "9:30", "Then"]
    texts = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 40))) for _ in range(200)]
    texts = [t.replace(" ", r.choice([" ", "  ", "\n", " \t"]), r.randint(0, 3)) for t in texts]
    rows = decontaminate.templated(spark.createDataFrame([(t,) for t in texts], "text string")).select("text", *decontaminate.FORMS).collect()
    for row in rows:
        assert [list(row[f]) for f in decontaminate.FORMS] == forms(row["text"])


def test_glued_units_are_slots(spark):
    item = "how much is 5kg of flour and 5kg of sugar together when the cook"
    rows = [(1, item.replace("5kg", "8kg", 1)), (2, item.replace("5kg", "8kg")), (3, item)]
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert {r["doc_id"]: r["reparameterised"] for r in found.collect()} == {2: True, 3: False}


def test_matches_are_those_of_brute_force(spark):
    """Plain windows of generated items in generated documents; repeated items and rows, and a very long text."""
    r = random.Random(5)
    vocab = [a + b + c for a in "bdkm" for b in "aeiou" for c in ("n", "ra", "lo")]
    prose = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, prose(r.randint(3, 30))) for i in range(20)] + [(20, None)]
    items.append((21, items[0][1]))
    docs = [(i, prose(40) + items[i % 20][1][: r.randint(1, 30)] + prose(20)) for i in range(60)]
    docs += [docs[0], (60, prose(30_000) + items[7][1] + prose(30_000)), (61, None), (62, [])]
    text = lambda rows: [(k, None if w is None else " ".join(w)) for k, w in rows]
    want = []
    for d, dw in docs:
        seen = {}
        for i, iw in items:
            if not dw or not iw:
                continue
            n = min(8, len(iw))
            own = seen.setdefault(n, {tuple(dw[k : k + n]) for k in range(len(dw) - n + 1)})
            windows = [tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)]
            matched = sum(w in own for w in windows)
            if matched >= 0.5 * len(windows):
                want.append((d, i, matched, len(windows)))
    spark_docs = spark.createDataFrame(text(docs), "doc_id bigint, text string")
    found = decontaminate.contaminated(spark_docs, spark.createDataFrame(text(items), "item_id bigint, text string"))
    assert {tuple(x) for x in found.select("doc_id", "item_id", "matched", "item_windows").collect()} == set(want)
    assert len(want) > 20


def test_marks_do_not_fill_the_plans(spark):
    """The driver prints a plan at each of its changes: the result's has no marks in it, those of the matches have bits."""
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "one two three four five six seven eight nine")], "item_id bigint, text string")
    out = decontaminate.contaminated(docs, items)
    assert len(out._jdf.queryExecution().toString()) < 60_000
    assert [(r["doc_id"], r["item_id"], r["matched"]) for r in out.collect()] == [(1, 7, 2)]


def test_marked_slots_let_all_known_windows_pass(spark):
    known = [0, -1, 63, 64, -64, 2**63 - 1, -(2**63), *range(-(2**62), 2**62, 2**57 + 12345)]
    marks = decontaminate.sieve(spark.createDataFrame([(x,) for x in known], "_window bigint"), len(known))
    assert all(-(2**63) <= x < 2**63 for x in marks) and len(str(marks)) < 2**15
    others = [x * 7919 + 5 for x in range(20_000)]
    rows = spark.createDataFrame([([*known, *others], [], [])], "_plain_w array<bigint>, _nameless_w array<bigint>, _template_w array<bigint>")
    found = rows.select(decontaminate.sifted(marks).alias("w")).first()["w"]
    assert {(r["at"], r["window"]) for r in found} >= set(enumerate(known)) and len(found) < len(known) + 500
