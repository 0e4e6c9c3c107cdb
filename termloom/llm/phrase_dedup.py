"""Operator 3, substring dedup by repeated-phrase automata.

1. The sieve of anchors.py names the documents with recurring 16-word phrases.
2. Their phrases are grouped by their very words; those that occur at least twice are confirmed.
3. Documents are dealt to blocks of a bounded size. A block's shard of the confirmed phrases, those met
   in the block, is compiled to an Aho-Corasick automaton over word numbers, and the block's documents
   stream through it; every occurrence of a phrase is located. An automaton is thus never larger than
   its block, a phrase that all documents share goes to each block once, and a document meets one shard.
4. A 35-word window whose anchor is a located phrase may recur (any other can't): those windows' hashes
   (two of 64 bits) are counted over the corpus, and words in windows that occur twice or more are removed.

Defined cases: a null or empty text has no words; a text below 35 words keeps all; repeated rows are
documents of their own, so their windows recur; a null doc_id is a document as any other; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.llm.anchors import candidates, chosen, key, recurring, short, window_anchors
from termloom.llm.common import SPACE, SPACE_RE, encoded, merged, mixed, partitions, rolled, stored, table, text_bytes, word_hashes

WINDOW, PHRASE = 35, 16
BLOCK_BYTES = 4_000_000
#: Sets the second hash of a window apart from the first.
SECOND = np.uint64(0x2545F4914F6CDD1D)


class Shard:
    """The automaton of one block's phrases, over numbers given to their words.

    A number is written as two letters of disjoint alphabets of about the root of their count: the automaton
    looks through the children of a node one by one, and its root has as many as there are first letters.
    """

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.phrases: list[list[int]] = []
        self.automaton = None

    def add(self, phrase: bytes) -> None:
        give = self.numbers.setdefault
        self.phrases.append([give(w, len(self.numbers)) for w in phrase.split(b" ")])

    def compile(self) -> None:
        import ahocorasick

        root = 1 << (len(self.numbers).bit_length() + 1) // 2
        high = len(self.numbers) // root + 2

        def letter(n: int) -> str:
            return chr(n if n < 0xD800 else n + 0x800)  # no surrogates

        names = [letter(1 + n // root) + letter(high + n % root) for n in range(len(self.numbers))]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for phrase in self.phrases:
            self.automaton.add_word("".join([names[n] for n in phrase]), 1)
        self.automaton.make_automaton()
        self.names, self.phrases = {w: names[n] for w, n in self.numbers.items()}, []

    def starts(self, words: list[bytes], phrase: int) -> np.ndarray:
        """Where the phrases start among the words."""
        if self.automaton is None:
            self.compile()
        get = self.names.get
        text = "".join([get(w, "\0\0") for w in words])
        return np.array([end // 2 for end, _ in self.automaton.iter(text)], np.int64) - (phrase - 1)


def removed_words(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """_key, _th (hash of the text), n_removed, kept_sha256 and runs of the documents with removed words."""
    width = window - phrase + 1

    def anchors_of(text):
        grams = rolled(word_hashes(encoded(text).split()), phrase)
        return short(grams[chosen(grams, window_anchors(grams, width), width)])

    found = candidates(docs, recurring(docs, anchors_of, 80), "phrase-candidates")
    blocks = max(1, text_bytes(found) // block_bytes)
    found = found.withColumn("block", F.pmod(F.xxhash64("rk"), F.lit(blocks)))

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            met: dict[tuple[int, bytes], int] = {}
            for block, text, hits in zip(batch["block"], batch["text"], batch["hits"], strict=True):
                words = encoded(text).split()
                grams = rolled(word_hashes(words), phrase)
                places = chosen(grams, window_anchors(grams, width), width)
                for p in places[np.isin(short(grams[places]), np.asarray(hits, np.int64))].tolist():
                    k = (block, b" ".join(words[p : p + phrase]))
                    met[k] = met.get(k, 0) + 1
            yield pd.DataFrame({"block": [k[0] for k in met], "payload": [k[1] for k in met], "n": list(met.values())})

    spoken = found.select("block", "text", "hits").mapInPandas(phrases, "block long, payload binary, n long")
    spoken = spoken.repartition(partitions(docs.sparkSession), "payload").groupBy("payload", "block").agg(F.sum("n").alias("n"))
    confirmed = spoken.withColumn("n", F.sum("n").over(Window.partitionBy("payload"))).where("n > 1")
    shards = confirmed.select("block", F.lit(-1).cast("long").alias("rk"), "payload")
    stream = shards.union(found.select("block", "rk", F.col("text").cast("binary"))).repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block", "rk")

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, current = Shard(), None
        for batch in batches:
            out = []
            for block, rk, payload in zip(batch["block"], batch["rk"], batch["payload"], strict=True):
                if block != current:
                    shard, current = Shard(), block
                if rk < 0:
                    shard.add(payload)
                    continue
                words = payload.split()
                if not shard.numbers or len(words) < window:
                    continue
                starts = shard.starts(words, phrase)
                if not len(starts):
                    continue
                # a window can recur only if its anchor is a located phrase
                hashes = word_hashes(words)
                grams = rolled(hashes, phrase)
                spoken_grams = np.full(len(grams), 2**64 - 1, np.uint64)
                spoken_grams[starts] = grams[starts]
                places = np.flatnonzero(window_anchors(spoken_grams, width) == window_anchors(grams, width))
                if len(places):
                    first = rolled(hashes, window)[places].view(np.int64)
                    second = rolled(mixed(hashes ^ SECOND), window)[places].view(np.int64)
                    out.append(pd.DataFrame({"window": first, "again": second, "rk": rk, "place": places.astype(np.int32)}))
            if out:
                yield pd.concat(out)

    windows = stream.mapInPandas(locate, "window long, again long, rk long, place int")
    again = windows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("window", "again"))).where("n > 1")
    places = again.groupBy("rk").agg(F.collect_list("place").alias("places"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, th, text, found_places in zip(batch["_key"], batch["_th"], batch["text"], batch["places"], strict=True):
                words, kept, at = encoded(text).split(), [], 0
                runs = merged(np.sort(np.asarray(found_places, np.int64)), window)
                for a, b in runs:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                rows.append((k, th, len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [list(r) for r in runs]))
            yield pd.DataFrame(rows, columns=["_key", "_th", "n_removed", "kept_sha256", "runs"])

    return (
        found.select("rk", "_key", F.xxhash64("text").alias("_th"), "text")
        .join(places, "rk")
        .select("_key", "_th", "text", "places")
        .mapInPandas(cut, "_key long, _th long, n_removed long, kept_sha256 string, runs array<array<long>>")
    )


def op3_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = F.regexp_replace(F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACE)), SPACE_RE, " ")
    whole = docs.select("doc_id", key().alias("_key"), F.xxhash64("text").alias("_th"), joined.alias("_joined"))
    count = F.when(F.col("_joined") == "", 0).otherwise(F.length("_joined") - F.length(F.translate("_joined", " ", "")) + 1).cast("long")
    whole = whole.select("doc_id", "_key", "_th", count.alias("n_words"), F.sha2("_joined", 256).alias("_whole"))
    cut = removed_words(docs).drop("runs").dropDuplicates(["_key", "_th"])
    out = whole.join(cut, ["_key", "_th"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "_whole").alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
s AS (SELECT rid, i, array_to_string(words[i:i + 34], ' ') AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 33)) AS i FROM d)),
h AS (SELECT rid, i, md5(g) AS g FROM s),
r AS (SELECT rid, i FROM h QUALIFY count(*) OVER (PARTITION BY g) > 1),
c AS (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + 35)) AS p FROM r)),
w AS (SELECT rid, words[p] AS word, p FROM (SELECT rid, words, unnest(range(1, len(words) + 1)) AS p FROM d)),
k AS (SELECT w.rid, string_agg(word, ' ' ORDER BY w.p) AS kept FROM w ANTI JOIN c ON w.rid = c.rid AND w.p = c.p GROUP BY w.rid),
n AS (SELECT rid, count(*) AS n FROM c GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid) LEFT JOIN n USING (rid)
"""
