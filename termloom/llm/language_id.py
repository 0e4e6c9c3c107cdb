"""Operator 6, language identification by rank-order profiles.

A text is folded to lower-case letters with one blank between words. Its n-grams of 1 to 3 characters
are ranked by frequency, and the most frequent ones are compared with each language's profile: the
distance is the sum of the differences of ranks, an n-gram that the profile lacks counting as the
profile's length. The language with the least distance is predicted; the score is one minus the distance
as a share of the greatest possible.

Profiles are learned from TRAINING_DOCS labelled documents per language at most, those with the least
hash of doc_id; n-grams are counted in parallel and only the top ranks reach the driver.

Defined cases: a null text or one without a letter (combining marks alone are none) is "und" with score 0; rows
without a doc_id are not held out, so they are learned from; with no learned language all
are "und"; of equal distances the first language in code-point order wins, of equally frequent n-grams
the one with the lower code comes first; repeated rows are predicted alike; an empty table gives an
empty result; lang, source and doc_id play no part in a prediction.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.llm.common import table

#: Ranks of a profile and of a document.
PROFILE, LONGEST = 300, 3
TRAINING_DOCS = 1000

_LETTER: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """2 for code points that are letters, 1 for combining marks, 0 for others."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter(("ML".find(unicodedata.category(chr(c))[0]) + 1 for c in range(0x110000)), np.uint8, 0x110000)
    return _LETTER


def folded(text: str | None) -> np.ndarray:
    """Code points of the lower-cased letters, other characters as single blanks, a blank at each end."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = letter_table()[points]
    letters = kinds > 0
    if not (kinds == 2).any():
        return np.zeros(0, np.int64)
    points = np.concatenate([[32], np.where(letters, points, 32), [32]]).astype(np.int64)
    return points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the text's n-grams (21 bits a character) and how often each occurs; single blanks left out."""
    points = folded(text)
    if not len(points):
        return points, points
    codes, grams = points, [points[points != 32]]
    for n in range(2, LONGEST + 1):
        if len(points) < n:
            break
        codes = (codes[: len(points) - n + 1] << 21) | points[n - 1 :]
        grams.append(codes)
    return np.unique(np.concatenate(grams), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The n most frequent codes, by falling count, then by code."""
    if len(codes) > n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))[:n]]


def distances(top: np.ndarray, profiles: list[np.ndarray]) -> list[int]:
    """The out-of-place distance of ranked codes to each profile."""
    ranks = np.arange(len(top))
    out = []
    for profile in profiles:
        order = np.argsort(profile)
        at = np.minimum(np.searchsorted(profile[order], top), len(profile) - 1)
        found = profile[order][at] == top
        out.append(int(np.where(found, np.abs(order[at] - ranks), PROFILE).sum()))
    return out


def learned(docs: DataFrame, training_docs: int = TRAINING_DOCS) -> dict[str, np.ndarray]:
    """Profiles by language from the rows of docs (doc_id, text, lang) that have a language and a letter."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: dict[str, tuple[list, list]] = {}
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                codes, counts = gram_counts(text)
                own = sums.setdefault(lang, ([], []))
                own[0].append(codes)
                own[1].append(counts)
            for lang, (codes, counts) in sums.items():
                values, place = np.unique(np.concatenate(codes), return_inverse=True)
                yield pd.DataFrame({"lang": lang, "code": values, "n": np.bincount(place, np.concatenate(counts), len(values)).astype(np.int64)})

    order = Window.partitionBy("lang").orderBy("_h")
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").withColumn("_h", F.xxhash64("doc_id", "lang"))
    # a bound on the hash is found first, so that only the chosen documents' texts are shuffled, if any
    bound = labelled.select("lang", "_h").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= training_docs).groupBy("lang").agg(F.max("_h").alias("_bound"))
    chosen = labelled.join(F.broadcast(bound) if bound.count() <= 10_000 else bound, "lang").where("_h <= _bound").select("lang", "text")
    grams = chosen.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = grams.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("_r") <= PROFILE)
    rows = top.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "code"))), lambda s: s["code"]).alias("codes")).collect()  # PROFILE codes a language
    return {r["lang"]: np.array(r["codes"], np.int64) for r in sorted(rows, key=lambda r: r["lang"])}


def predicted(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """docs' doc_id and held_out with lang_pred and score."""
    langs, ranks = list(profiles), list(profiles.values())

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            langs_out, scores = [], []
            for text in batch["text"]:
                top = ranked(*gram_counts(text)) if langs else ()
                if not len(top):
                    langs_out.append("und")
                    scores.append(0.0)
                    continue
                found = distances(top, ranks)
                best = int(np.argmin(found))
                langs_out.append(langs[best])
                scores.append(1 - found[best] / (PROFILE * len(top)))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "lang_pred": langs_out, "score": scores})

    return docs.select("doc_id", "held_out", "text").mapInPandas(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))
    return predicted(docs, learned(docs.where("NOT held_out")))
