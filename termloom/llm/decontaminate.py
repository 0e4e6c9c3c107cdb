"""Operator 2, benchmark decontamination by template canonicalisation, in SQL functions only.

Texts become templates: numbers, names (capitalised words inside a sentence) and units of measure are
replaced with <num>, <name> and <unit>, other words are case-folded and lose punctuation at their ends.
Windows of WINDOW words are hashed and joined with those of the benchmark, of the template, of the one
without names (in capitals or title case names can't be told) and of the plain words, which a literal
copy always meets whatever its case or line breaks; an item with fewer words is one window. For each
document, item and offset the aligned slots of a run of consecutive windows are compared: a value must
become the same value everywhere in the run (two may become one). Windows of equal plain words count
whatever the slots. A document is contaminated by an item if matches hold a share of the item's windows.

The benchmark's windows are counted first: up to BROADCAST_WINDOWS they are broadcast and the documents
are streamed past them without a shuffle, and a table of marks (a bit for each slot of their hashes) drops
nearly all other windows before they become rows; beyond, the same join is a shuffled one of all windows.

Defined cases: null and empty texts match nothing; windows of which less than half the words are literal
are too general for templates and match by their plain words alone, the share is the larger of that of all
windows and that of the others; repeated rows and items are judged each by itself;
empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.llm.common import SPACE, SPACE_RE, stored, table

WINDOW = 8
#: Share of an item's windows that contaminates.
COVERAGE = 0.5
BROADCAST_WINDOWS = 1_000_000
UNITS = "mm|cm|m|km|mg|g|kg|t|ml|l|s|ms|min|h|hz|kb|mb|gb|tb|w|kw|v|a|°c|°f|mph|ft|lb|oz|inch|inches|miles?|meters?|metres?|liters?|litres?|grams?|hours?|minutes?|seconds?|days?|weeks?|years?|dollars?|euros?|percent"
SLOTS = ("<num>", "<name>", "<unit>", "<num><unit>")


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE))


def plain(text: Column) -> Column:
    """Case-folded, punctuation at the ends of words removed (a word of nothing else keeps a character).

    The patterns begin with what is rare and look behind it: a look at every character would cost far more.
    """
    text = F.regexp_replace(text, r"""[.,;:!?)"'\]](?<=[^\x20\x09-\x0D].)[.,;:!?)"'\]]*(?=[\x20\x09-\x0D]|$)""", "")
    text = F.lower(F.regexp_replace(text, r"""["'(\[](?<=(?:^|[\x20\x09-\x0D]).)["'(\[]*(?=[^\x20\x09-\x0D])""", ""))
    return F.replace(F.replace(text, F.lit("ς"), F.lit("σ")), F.lit("ß"), F.lit("ss"))


def unnamed(text: Column) -> Column:
    """The text with <name> for capitalised words inside a sentence, up to 64 white-space characters behind a word of it."""
    return F.regexp_replace(text, r"\p{Lu}(?<=[^.!?:\x20\x09-\x0D][\x20\x09-\x0D]{1,64}.)[\p{L}'-]*", "<name>")


def unnumbered(text: Column) -> Column:
    """A plain text with <num> for numbers and <unit> for the units of measure behind them."""
    begin, rest = r"(?<=(?:^|[\x20\x09-\x0D(\[]).)", r"[\p{Nd}.,:/%-]*"
    text = F.regexp_replace(text, rf"\p{{Nd}}{begin}{rest}|[$€£+-]{begin}\p{{Nd}}{rest}", "<num>")
    units = F.regexp_replace(text, rf"<num>([\x20\x09-\x0D]*)(?:{UNITS})(?=[\x20\x09-\x0D]|$)", "<num>$1<unit>")
    return F.when(F.contains(text, F.lit("<num>")), units).otherwise(text)


#: The forms of a text whose windows are joined: its plain words, and templates without and with names.
FORMS = ("_plain", "_nameless", "_template")


def neighbours(a: str, b: str, shift: int) -> Column:
    """The hash of a[i] and b[i + shift] for every i that has both."""
    return F.expr(f"zip_with(slice({a}, 1, greatest(size({b}) - {shift}, 0)), slice({b}, {shift + 1}, greatest(size({b}) - {shift}, 0)), (x, y) -> xxhash64(x, y))")


def hashed(df: DataFrame, length: int) -> DataFrame:
    """df with _plain_w, _nameless_w and _template_w: the hashes of the windows of a length, by doubling."""
    for form in FORMS:
        block, span, done = f"{form}_h", 1, 0
        whole = None
        while span <= length:
            if length & span:
                if whole is None:
                    whole = block
                else:
                    df = df.withColumn(f"{form}_w{done}", neighbours(whole, block, done))
                    whole = f"{form}_w{done}"
                done += span
            span *= 2
            if span <= length:  # a column of its own, or the step would be computed anew for each use
                df = df.withColumn(f"{form}_b{span}", neighbours(block, block, span // 2))
                block = f"{form}_b{span}"
        df = df.withColumn(f"{form}_w", F.col(whole))
    return df


def windows() -> Column:
    """(at, form, window) of all windows of hashed(), a template's only where they differ from those of the forms before it."""

    def made(number: int) -> Column:
        own = f"{FORMS[number]}_w"
        rows = F.transform(own, lambda x, i: F.struct(i.alias("at"), F.lit(number).alias("form"), x.alias("window")))
        return F.filter(rows, lambda r: reduce(Column.__and__, [~r["window"].eqNullSafe(F.get(f"{form}_w", r["at"])) for form in FORMS[:number]], F.lit(True)))

    return F.concat(*map(made, range(len(FORMS))))


def sieve(known: DataFrame, n: int) -> list[int]:
    """A bit for each slot of a hash of the n known windows, in words of 64: 1 where one of them falls."""
    slots = 1 << min(24, max(16, (32 * n).bit_length()))
    out = [0] * (slots >> 6)
    for r in known.select(F.col("_window").bitwiseAND(F.lit(slots - 1)).alias("s")).distinct().toLocalIterator():
        out[r["s"] >> 6] |= 1 << (r["s"] & 63)
    return [x - (x >> 63 << 64) for x in out]


def sifted(marks: list[int] | None) -> Column:
    """(at, window) of the windows of hashed() that may be known: those in a marked slot, or all."""
    words = None if marks is None else F.from_json(F.lit(str(marks)), "array<bigint>")

    def made(form: str) -> Column:
        own = f"{form}_w"
        if marks is None:
            return F.transform(own, lambda x, i: F.struct(i.alias("at"), x.alias("window")))
        met = lambda x: F.getbit(F.get(words, F.shiftright(x, 6).bitwiseAND(F.lit(len(marks) - 1)).cast("int")), x.bitwiseAND(F.lit(63)).cast("int")) == 1
        places = F.array_compact(F.transform(own, lambda x, i: F.when(met(x), i)))
        return F.transform(places, lambda i: F.struct(i.alias("at"), F.get(own, i).alias("window")))

    return F.array_distinct(F.concat(*map(made, FORMS)))


def templated(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the words of each form, _plain, _nameless and _template, and their hashes (form_h).

    The hashes of a form are left out where it is the same as the one before.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"_p": plain(body), "_u": unnamed(body)})
    df = df.withColumn("_n", unnumbered(F.col("_p")))
    df = df.withColumns({"_plain": words_of(F.col("_p")), "_numbered": F.col("_n") != F.col("_p"), "_named": F.contains("_u", F.lit("<name>"))})
    df = df.withColumn("_nameless", F.when(F.col("_numbered"), words_of(F.col("_n"))).otherwise(F.col("_plain")))
    # a name is a part of one word: the other words are those of the form without names
    own = F.zip_with(words_of(F.col("_u")), "_nameless", lambda u, w: F.when(F.contains(u, F.lit("<name>")), unnumbered(plain(u))).otherwise(w))
    df = df.withColumn("_template", F.when(F.col("_named"), own).otherwise(F.col("_nameless")))
    none = F.array().cast("array<bigint>")
    hashes = {f"{form}_h": F.transform(form, lambda w: F.xxhash64(w)) for form in FORMS}
    for form, differs in (("_nameless", "_numbered"), ("_template", "_named")):
        hashes[f"{form}_h"] = F.when(F.col(differs), hashes[f"{form}_h"]).otherwise(none)
    return df.withColumns(hashes).drop("_p", "_u", "_n", "_numbered", "_named")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, _th, item_id, matched, item_windows, coverage, n_slots, reparameterised; one row per pair."""
    items = templated(benchmark.select("item_id", "text").where("text IS NOT NULL"))
    items = items.withColumn("_length", F.least(F.size("_template"), F.lit(window))).where("_length > 0")
    lengths = sorted(r[0] for r in items.select("_length").distinct().collect())  # window at most

    def at(form: str, length: int | Column) -> Column:
        return F.slice(form, F.col("_at") + 1, length)

    def specific(words: Column) -> Column:
        return 2 * F.size(F.filter(words, lambda w: ~w.isin(*SLOTS))) >= F.size(words)

    def item_windows(length: int) -> DataFrame:
        out = hashed(items.where(F.col("_length") == length), length).select("item_id", *FORMS, F.explode(windows()).alias("_w"))
        out = out.select("item_id", *FORMS, F.col("_w.at").alias("_at"), F.col("_w.form").alias("_form"), F.col("_w.window").alias("_window"))
        own = F.when(F.col("_form") == 0, at("_plain", length)).when(F.col("_form") == 1, at("_nameless", length)).otherwise(at("_template", length))
        out = out.select(
            F.col("item_id"),
            F.lit(length).alias("_item_length"),
            "_form",
            "_window",
            F.col("_at").alias("_item_at"),
            own.alias("_item_template"),
            at("_plain", length).alias("_item_words"),
            specific(at("_template", length)).alias("_specific"),
        )
        return out.where((F.col("_form") == 0) | specific(F.col("_item_template")))

    if not lengths:
        lengths = [window]
    known = stored(reduce(DataFrame.union, map(item_windows, lengths)), "item-windows")
    n_windows = known.where("_form = 0").groupBy("item_id").agg(F.count(F.lit(1)).alias("_all"), F.count_if("_specific").alias("_some"))
    n_known = known.count()
    side = F.broadcast(known) if n_known <= broadcast_windows else known
    marks = sieve(known, n_known) if n_known <= broadcast_windows else None
    source = templated(docs.select("doc_id", "text").where("text IS NOT NULL")).withColumn("_th", F.xxhash64("text"))

    def matched(length: int) -> DataFrame:
        rows = hashed(source, length).select("doc_id", "_th", *FORMS, F.explode(sifted(marks)).alias("_w"))
        rows = rows.select("doc_id", "_th", *FORMS, F.col("_w.at").alias("_at"), F.col("_w.window").alias("_window"))
        rows = rows.join(side.where(F.col("_item_length") == length), "_window")
        rows = rows.where(reduce(Column.__or__, [at(form, length) == F.col("_item_template") for form in FORMS]))
        # the words themselves are needed for matches alone
        own = at("_plain", length)
        slots = F.filter(
            F.transform(F.arrays_zip(F.col("_item_template").alias("t"), F.col("_item_words").alias("i"), own.alias("d")), lambda s: F.struct(s["t"].alias("t"), s["i"].alias("i"), s["d"].alias("d"))),
            lambda s: s["t"].isin(*SLOTS),
        )
        return rows.select("doc_id", "_th", "item_id", "_item_at", (F.col("_at") - F.col("_item_at")).alias("_offset"), "_specific", (own == F.col("_item_words")).alias("_literal"), slots.alias("_slots"))

    # stored, as the marks are a literal: each event of the aggregations behind them would print it anew
    found = stored(reduce(DataFrame.union, map(matched, lengths)), "matched-windows")
    offset = ["doc_id", "_th", "item_id", "_offset"]
    placed = found.groupBy(*offset, "_item_at").agg(F.bool_or("_literal").alias("_literal"), F.first("_specific").alias("_specific"), F.array_distinct(F.flatten(F.collect_set("_slots"))).alias("_slots"))
    placed = placed.withColumn("_run", F.col("_item_at") - F.row_number().over(Window.partitionBy(*offset).orderBy("_item_at")))
    # a run has no more rows than the item has windows
    runs = placed.groupBy(*offset, "_run").agg(F.collect_list(F.struct("_item_at", "_specific", "_literal")).alias("_places"), F.array_distinct(F.flatten(F.collect_list("_slots"))).alias("_slots"))
    consistent = F.size(F.array_distinct(F.transform("_slots", lambda s: F.struct(s["t"], s["i"])))) == F.size("_slots")
    # literal windows count whatever the slots of the others
    runs = runs.select(
        *offset,
        F.when(consistent, F.col("_places")).otherwise(F.filter("_places", lambda x: x["_literal"])).alias("_places"),
        F.when(consistent, F.col("_slots")).otherwise(F.filter("_slots", lambda s: F.lit(False))).alias("_slots"),
    )
    per = runs.groupBy(*offset).agg(F.flatten(F.collect_list("_places")).alias("_places"), F.array_distinct(F.flatten(F.collect_list("_slots"))).alias("_slots"))
    out = per.groupBy("doc_id", "_th", "item_id").agg(
        F.array_distinct(F.transform(F.flatten(F.collect_list("_places")), lambda x: F.struct(x["_item_at"].alias("at"), x["_specific"].alias("specific")))).alias("_places"),
        F.max(F.size("_slots")).cast("long").alias("n_slots"),
        F.max(F.exists("_slots", lambda s: s["i"] != s["d"])).alias("reparameterised"),
    )
    out = out.join(n_windows, "item_id")
    # of all windows, or of those that templates can match: whichever share is larger
    some = F.size(F.filter("_places", lambda x: x["specific"])).cast("long")
    shares = [F.struct((n / total).alias("coverage"), n.alias("matched"), total.alias("item_windows")) for n, total in ((F.size("_places").cast("long"), F.col("_all")), (some, F.when(F.col("_some") > 0, F.col("_some"))))]
    out = out.withColumn("_best", F.when((F.col("_some") > 0) & (shares[1] > shares[0]), shares[1]).otherwise(shares[0]))
    return out.select("doc_id", "_th", "item_id", "_best.matched", "_best.item_windows", "_best.coverage", "n_slots", "reparameterised").where(F.col("coverage") >= coverage)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items that contaminate them."""
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "matched", "item_windows", "coverage", "n_slots", "reparameterised")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item, columns unchanged."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "_th").distinct()
    gone = stored(found, "contaminated")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["_th"]), "left_anti")
