"""Anchors: a lossless sieve for passages that recur.

Of every window of a text the smallest hash of its inner grams is the window's anchor, so equal windows
have equal anchors. Only one gram in about ten is the anchor of some window, and only windows whose
anchor occurs more than once in the whole corpus can recur: the operators that look for repeats first
find the recurring anchors and then look at windows of those alone.

Anchors travel to buckets by hash in sorted, compressed blocks (a few bytes each); as they serve as a
sieve only, 48 bits of the hash are sent. The answer goes back as (document, anchors) rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import partitions, sliding_min, stored, text_bytes

#: Stands for a null doc_id; it comes after all others.
NO_ID = 2**63 - 1
#: Set in an answered anchor that more documents have than one task should hold.
HOT_BIT = 1 << 60
FLUSH, BUCKET_ANCHORS = 1_000_000, 1_500_000


def key(column: str = "doc_id"):
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def window_anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """The least of every width consecutive gram hashes: the anchor of each window."""
    return sliding_min(grams, width)


def chosen(grams: np.ndarray, anchors: np.ndarray, width: int) -> np.ndarray:
    """Positions of the grams that are the anchor of some window."""
    if not len(anchors):
        return np.zeros(0, np.int64)
    edge = np.full(width - 1, 2**64 - 1, np.uint64)
    highest = ~sliding_min(np.concatenate([edge, ~anchors, edge]), width)
    return np.flatnonzero(grams == highest)


def short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(16)).astype(np.int64)


def _packed(hashes: np.ndarray, docs: np.ndarray) -> bytes:
    """Sorted hashes as differences, by byte planes, then the documents' numbers."""
    steps = np.diff(hashes, prepend=np.int64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    head = np.array([len(hashes)], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + steps.tobytes() + docs.astype("<u4").tobytes())


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(steps.astype(np.int64)), np.frombuffer(raw, "<u4", n, 8 + 8 * n)


def recurring(docs: DataFrame, anchors_of: Callable[[str | None], np.ndarray], bytes_per_anchor: int, hot: int = 2**62) -> DataFrame:
    """_key, hits (array<long>): the anchors of each document that occur more than once.

    anchors_of gives the short anchors of a text, as often as they are to count. An anchor that more
    than hot rows have carries HOT_BIT.
    """
    buckets = max(partitions(docs.sparkSession), text_bytes(docs) // bytes_per_anchor // BUCKET_ANCHORS)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, keys, n = [], [], 0
            for k, text in zip(batch["_key"], batch["text"], strict=True):
                a = anchors_of(text)
                if len(a):
                    found.append(a)
                    keys.append(k)
                    n += len(a)
                if n >= FLUSH:
                    yield dealt(found, keys)
                    found, keys, n = [], [], 0
            if n:
                yield dealt(found, keys)

    def dealt(found: list[np.ndarray], keys: list[int]) -> pd.DataFrame:
        hashes, docs_of = np.concatenate(found), np.repeat(np.arange(len(found)), [len(x) for x in found])
        bucket = hashes % buckets
        order = np.lexsort((hashes, bucket))
        hashes, docs_of, bucket = hashes[order], docs_of[order], bucket[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        rows = []
        all_keys = np.array(keys, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own, at = np.unique(docs_of[a:b], return_inverse=True)
            rows.append((int(bucket[a]), all_keys[own], _packed(hashes[a:b], at)))
        return pd.DataFrame(rows, columns=["bucket", "keys", "block"])

    def meet(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        blocks = [_unpacked(x) for x in group["block"]]
        values, counts = np.unique(np.concatenate([x[0] for x in blocks]), return_counts=True)
        values, counts = values[counts > 1], counts[counts > 1]
        out_keys, out_hits = [], []
        for (hashes, at), keys in zip(blocks, group["keys"], strict=True):
            place = np.searchsorted(values, hashes)
            place[place == len(values)] = 0
            keep = values[place] == hashes if len(values) else np.zeros(len(hashes), bool)
            place = place[keep]
            out_keys.append(np.asarray(keys, np.int64)[at[keep]])
            out_hits.append(values[place] | np.where(counts[place] > hot, HOT_BIT, 0))
        return pd.DataFrame({"_key": np.concatenate(out_keys), "hit": np.concatenate(out_hits)}).drop_duplicates()

    rows = docs.select(key().alias("_key"), "text").mapInPandas(spread, "bucket long, keys array<long>, block binary")
    met = rows.groupBy("bucket").applyInPandas(meet, "_key long, hit long")
    return met.groupBy("_key").agg(F.collect_list("hit").alias("hits"))


def candidates(docs: DataFrame, hits: DataFrame, name: str, keep=None) -> DataFrame:
    """The documents with recurring anchors, with a row number: rk, _key, text, hits.

    Later steps name documents by rk; it is fixed as the rows are stored.
    """
    out = docs.select(key().alias("_key"), "text").join(hits, "_key")
    if keep is not None:
        out = out.where(keep)
    return stored(out.select(F.monotonically_increasing_id().alias("rk"), "_key", "text", "hits"), name)
