"""Operator 8, suffix-array dedup by a hash-compared suffix sort.

1. Copies of a whole text are found by digest: all but the one with the smallest doc_id go entirely, and
   are no candidates below (their windows are in the smaller document as well).
2. The sieve of anchors.py leaves the windows of 50 bytes whose anchor recurs. Neighbouring windows with
   one anchor make a unit: a stretch of bytes, sent to the task of its anchor. Equal windows have equal
   anchors, so every repeat meets in one task.
3. There equal units are merged, and where an anchor still has different units the suffixes at their
   window starts (those whose first 50 bytes' hash is met again) are sorted: a bottom-up mergesort in vector operations, in which two suffixes are
   compared by binary search for their longest common extension on prefix polynomial hashes, then by one
   byte. Neighbours in suffix order with 50 common bytes are verified byte by byte and share the smallest
   doc_id; a window of a larger doc_id is removed.
4. An anchor that more than HOT_ROWS documents have would make a large task; its windows are
   grouped by their bytes with partial aggregation instead, which gives the same smallest doc_id.

Defined cases: a null or empty text has no bytes, a text below 50 bytes keeps all; rows with equal
doc_ids don't remove each other's bytes; null doc_ids come after all others; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.anchors import HOT_BIT, chosen, key, recurring, short, window_anchors
from termloom.llm.common import Scope, encoded, mixed, partitions, stored, table, texts_of

WINDOW, GRAM = 50, 20
UNIT = ["anchor", "rk", "_key", "start", "data"]
HOT_ROWS = 50_000
UNITS_PER_TASK = 60_000
#: Bytes of units that a task holds before it packs them. Tasks grow in number with the input, and so do the
#: blocks of each packing: few packings, and nothing but vector operations around a block.
HELD_BYTES = 8 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_BLOCK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _BLOCK), _powers(_INVERSE, _BLOCK)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and inverse powers up to n."""
    global _UP, _DOWN
    if n > len(_UP):
        _UP, _DOWN = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)
    return _UP, _DOWN


class PrefixHashes:
    """Polynomial hashes of all prefixes of a byte string; any substring's hash in constant time."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, length) -> np.ndarray:
        return (self.sums[starts + length] - self.sums[starts]) * self.down[starts]

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return np.zeros(0, np.uint64) if n <= 0 else (self.sums[length:] - self.sums[:n]) * self.down[:n]


def gram_hashes(text: bytes, gram: int) -> np.ndarray:
    return mixed(PrefixHashes(np.frombuffer(text, np.uint8)).all(gram))


class SuffixSorter:
    """Sorts suffixes of a buffer, each at least limit bytes from its end, by their first limit bytes."""

    def __init__(self, data: np.ndarray, limit: int) -> None:
        self.data, self.limit, self.hashes = data, limit, PrefixHashes(data)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes a and b have in common, limit at most: binary search on hashes."""
        low = np.zeros(len(a), np.int64)
        step = 1 << (self.limit.bit_length() - 1)
        while step:
            longer = low + step
            fits = np.flatnonzero(longer <= self.limit)
            same = self.hashes.of(a[fits], longer[fits]) == self.hashes.of(b[fits], longer[fits])
            low[fits[same]] = longer[fits[same]]
            step >>= 1
        return low

    def less(self, suffixes: np.ndarray, heads: np.ndarray, whole: np.ndarray, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix x comes before suffix y, numbers of suffixes; of equal ones or_equal says.

        Most pairs differ in their first 8 bytes (heads) or have equal hashes of all limit bytes (whole);
        for the others the common extension is searched.
        """
        left, right = heads[x], heads[y]
        out = left < right
        tied = np.flatnonzero(left == right)
        equal = whole[x[tied]] == whole[y[tied]]
        out[tied[equal]] = or_equal[tied[equal]]
        tied = tied[~equal]
        if len(tied):
            a, b = suffixes[x[tied]], suffixes[y[tied]]
            at = self.common(a, b)
            end = at >= self.limit
            at[end] = 0
            out[tied] = np.where(end, or_equal[tied], self.data[a + at] < self.data[b + at])
        return out

    def sorted(self, suffixes: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The order of the suffixes inside each group (groups are runs of equal numbers)."""
        n = len(suffixes)
        heads, whole = np.zeros(n, np.uint64), self.hashes.of(suffixes, self.limit)
        for i in range(min(8, self.limit)):
            heads = (heads << np.uint64(8)) | self.data[suffixes + i].astype(np.uint64)
        order = np.arange(n)
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.concatenate([begin, [n]]))
        first, size = np.repeat(begin, sizes), np.repeat(sizes, sizes)
        width = 1
        while width < sizes.max(initial=0):
            at = np.flatnonzero(size > width)  # places of groups that are not yet one run
            inside = at - first[at]
            pair = inside // (2 * width) * (2 * width)
            left = inside - pair < width
            other = first[at] + np.where(left, pair + width, pair)
            stop = first[at] + np.minimum(np.where(left, pair + 2 * width, pair + width), size[at])
            low, high = np.minimum(other, stop), stop.copy()
            mine = order[at]
            while len(busy := np.flatnonzero(low < high)):
                middle = (low[busy] + high[busy]) // 2
                # stable: a left element goes before its equals on the right
                up = self.less(suffixes, heads, whole, order[middle], mine[busy], ~left[busy])
                low[busy] = np.where(up, middle + 1, low[busy])
                high[busy] = np.where(up, high[busy], middle)
            rank = low - np.minimum(other, stop)
            own = inside - pair - np.where(left, 0, width)
            new = order.copy()
            new[first[at] + pair + own + rank] = order[at]
            order = new
            width *= 2
        return order

    def equal_runs(self, ordered: np.ndarray, group: np.ndarray) -> np.ndarray:
        """A run number for each ordered suffix; in a run all limit bytes are equal, verified."""
        same = np.zeros(len(ordered), bool)
        near = np.flatnonzero(group[1:] == group[:-1])
        same[near + 1] = self.common(ordered[near], ordered[near + 1]) >= self.limit
        views = np.lib.stride_tricks.sliding_window_view(self.data, self.limit)
        for at in np.array_split(np.flatnonzero(same), max(1, len(same) // 100_000)):
            same[at] = (views[ordered[at]] == views[ordered[at - 1]]).all(axis=1)
        return np.cumsum(~same) - 1


def units_of(text: bytes, hits: np.ndarray, window: int, gram: int) -> list[tuple[int, int, int]]:
    """(anchor, first window start, last window start) of the windows whose anchor is among the hits."""
    width = window - gram + 1
    anchors = short(window_anchors(gram_hashes(text, gram), width))
    at = np.flatnonzero(np.isin(anchors, hits))
    if not len(at):
        return []
    cuts = np.flatnonzero((np.diff(at) > 1) | (np.diff(anchors[at]) != 0)) + 1
    begins, ends = at[np.concatenate([[0], cuts])], at[np.concatenate([cuts - 1, [len(at) - 1]])]
    return list(zip(anchors[begins].tolist(), begins.tolist(), ends.tolist(), strict=True))


def packed(head: np.ndarray, data: list[bytes], tasks: int) -> pd.DataFrame:
    """The units (head: anchor, rk, _key, start; their bytes) as a compressed row for each task that has some."""
    task = (mixed(head[0].view(np.uint64)) % np.uint64(tasks)).astype(np.int64)
    order = np.lexsort((head[0], task))
    task, data = task[order], [data[i] for i in order.tolist()]
    head = np.concatenate([head[:, order], np.array([[len(x) for x in data]], np.int64)])
    ends, data = np.concatenate([[0], np.cumsum(head[4])]), b"".join(data)
    begins = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
    steps = np.diff(head[0], prepend=0)
    steps[begins] = head[0][begins]
    head[0] = steps
    cuts = [*begins.tolist(), len(task)]
    at = ends[cuts].tolist()
    packer = zstandard.ZstdCompressor(level=3)
    blocks = [packer.compress(head[:, cuts[i] : cuts[i + 1]].tobytes() + data[at[i] : at[i + 1]]) for i in range(len(begins))]
    return pd.DataFrame({"task": task[begins], "n": np.diff(cuts), "block": blocks})


def packings(parts: Iterator[list[tuple]], tasks: int) -> Iterator[pd.DataFrame]:
    """The units of all parts, packed whenever HELD_BYTES have gathered."""
    heads, data, size = [], [], 0
    for units in parts:
        if units:
            *head, own = zip(*units, strict=True)
            heads.append(np.array(head, np.int64))
            data += own
            size += sum(map(len, own))
        if size >= HELD_BYTES:
            yield packed(np.concatenate(heads, axis=1), data, tasks)
            heads, data, size = [], [], 0
    if heads:
        yield packed(np.concatenate(heads, axis=1), data, tasks)


def unpacked(counts: list[int], blocks: list[bytes]) -> pd.DataFrame:
    """The units of one task, from its blocks."""
    opener, heads, data = zstandard.ZstdDecompressor(), [], []
    for n, block in zip(counts, blocks, strict=True):
        raw = opener.decompress(block)
        head = np.frombuffer(raw, np.int64, 5 * n).reshape(5, n)
        ends = (40 * n + np.cumsum(head[4])).tolist()
        data += [raw[a:b] for a, b in zip([40 * n, *ends], ends, strict=False)]
        heads.append(np.concatenate([np.cumsum(head[:1], axis=1), head[1:4]]))
    return pd.DataFrame(dict(zip(UNIT[:4], np.concatenate(heads, axis=1), strict=True)) | {"data": data})


def repeated_spans(group: pd.DataFrame, window: int) -> pd.DataFrame:
    """rk, first and last start of windows that a smaller document has, for the units of one task."""
    columns = ["rk", "first", "last"]
    group = group.sort_values("anchor", kind="stable", ignore_index=True)
    data = group["data"].tolist()
    anchor, keys = group["anchor"].to_numpy(), group["_key"].to_numpy(np.int64)
    of: dict[tuple[int, bytes], int] = {}
    unit = np.array([of.setdefault(x, len(of)) for x in zip(anchor.tolist(), data, strict=True)], np.int64)
    least = np.full(len(of), 2**63 - 1, np.int64)
    np.minimum.at(least, unit, keys)
    texts = [x[1] for x in of]
    unit_anchor = np.array([x[0] for x in of], np.int64)
    lengths = np.array([len(x) for x in texts], np.int64)
    offset = np.concatenate([[0], np.cumsum(lengths)])
    starts = lengths - window + 1
    # for every window of every distinct unit: the smallest doc_id that has it
    smallest = np.repeat(least, starts)
    first = np.concatenate([[0], np.cumsum(starts)])
    alone = np.bincount(np.unique(unit_anchor, return_inverse=True)[1])
    several = alone[np.unique(unit_anchor, return_inverse=True)[1]] > 1
    if several.any():
        mine = np.repeat(several, starts)
        suffix = (np.repeat(offset[:-1] - first[:-1], starts) + np.arange(first[-1]))[mine]
        groups = np.repeat(unit_anchor, starts)[mine]
        sorter = SuffixSorter(np.frombuffer(b"".join(texts), np.uint8), window)
        # a suffix whose window's hash no other has is equal to none: only the others are sorted
        _, place, often = np.unique(sorter.hashes.of(suffix, window), return_inverse=True, return_counts=True)
        shared = np.flatnonzero(often[place] > 1)
        at, suffix, groups = np.flatnonzero(mine)[shared], suffix[shared], groups[shared]
        if len(at):
            order = sorter.sorted(suffix, groups)
            run = sorter.equal_runs(suffix[order], groups[order])
            own = smallest[at]
            run_least = np.full(run[-1] + 1, 2**63 - 1, np.int64)
            np.minimum.at(run_least, run, own[order])
            own[order] = run_least[run]
            smallest[at] = own
    out = []
    rks, begins = group["rk"].to_numpy(np.int64), group["start"].to_numpy(np.int64)
    later = np.flatnonzero(keys > np.minimum.reduceat(smallest, first[:-1])[unit])
    for some in np.array_split(later, len(later) // 20_000 + 1):
        n = starts[unit[some]]
        row = np.repeat(np.arange(len(some)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = np.flatnonzero(smallest[first[unit[some]][row] + place] < keys[some][row])
        if len(at):
            apart = (np.diff(at) > 1) | (np.diff(row[at]) != 0)
            a, b = at[np.concatenate([[True], apart])], at[np.concatenate([apart, [True]])]
            mine = some[row[a]]
            out.append(np.stack([rks[mine], begins[mine] + place[a], begins[mine] + place[b]], axis=1))
    out = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    return pd.DataFrame(out, columns=columns, dtype=np.int64)


def removed_bytes(docs: DataFrame, copies: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_rows: int = HOT_ROWS, units_per_task: int = UNITS_PER_TASK) -> DataFrame:
    """_key, _th, n_removed, n_spans, kept_sha256, runs of the documents with removed bytes, copies left out.

    copies: _key, digests of the texts of that doc_id which a smaller doc_id has as well.
    """
    width = window - gram + 1

    def anchors_of(text):
        grams = gram_hashes(encoded(text), gram)
        return np.unique(short(grams[chosen(grams, window_anchors(grams, width), width)]))

    hits = recurring(docs, anchors_of, 16, hot_rows).join(copies, "_key", "left")
    named = docs.select(key().alias("_key"), F.xxhash64("text").alias("_th"), F.md5(F.col("text").cast("binary")).alias("_digest"))
    found = named.join(hits, "_key").where("digests IS NULL OR NOT array_contains(digests, _digest)").dropDuplicates(["_key", "_th"])
    found = stored(found.select(F.monotonically_increasing_id().alias("rk"), "_key", "_th", "hits"), "suffix-candidates")
    texts = docs.select(key().alias("_key"), F.xxhash64("text").alias("_th"), "text")

    def pieces(batch: pd.DataFrame, hot: bool) -> list[tuple]:
        """(anchor, rk, _key, start, bytes) of the units whose anchor is hot, or is not."""
        rows = []
        for rk, k, text, hits in zip(batch["rk"], batch["_key"], batch["text"], batch["hits"], strict=True):
            data, hits = encoded(text), np.asarray(hits, np.int64)
            hits = hits[(hits >= HOT_BIT) == hot] & ~np.int64(HOT_BIT)
            rows += [(anchor, rk, k, a, data[a : b + window]) for anchor, a, b in units_of(data, hits, window, gram)]
        return rows

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return packings((pieces(batch, False) for batch in batches), tasks)

    def hot_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(pieces(batch, True), columns=UNIT)[["rk", "_key", "start", "data"]]

    def spans_of(group: pd.DataFrame) -> pd.DataFrame:
        return repeated_spans(unpacked(group["n"].tolist(), group["block"].tolist()), window)

    n_units = found.agg(F.coalesce(F.sum(F.size("hits")), F.lit(0))).first()[0]
    tasks = max(partitions(docs.sparkSession), n_units // units_per_task)
    rows = texts_of(texts, found, ["_key", "_th"]).select("rk", "_key", "text", "hits")
    spans = rows.mapInPandas(dealt, "task long, n long, block binary").groupBy("task").applyInPandas(spans_of, "rk long, first long, last long")
    if hot_rows < 2**62 and not found.where(F.exists("hits", lambda h: h >= HOT_BIT)).isEmpty():
        wide = rows.mapInPandas(hot_units, "rk long, _key long, start int, data binary").select("rk", "_key", "start", F.posexplode(F.expr(f"transform(sequence(1, octet_length(data) - {window - 1}), i -> substring(data, i, {window}))")).alias("at", "bytes"))
        least = wide.groupBy("bytes").agg(F.min("_key").alias("least"))
        more = wide.join(least, "bytes").where("_key > least").select("rk", (F.col("start") + F.col("at")).cast("long").alias("first"))
        spans = spans.union(more.select("rk", "first", F.col("first").alias("last")))
    runs = spans.groupBy("rk").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    runs = stored(found.select("rk", "_key", "_th").join(runs, "rk").drop("rk"), "suffix-runs")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, th, text, found_spans in zip(batch["_key"], batch["_th"], batch["text"], batch["spans"], strict=True):
                data, kept, joined = encoded(text), [], []
                for first, last in sorted((s["first"], s["last"]) for s in found_spans):
                    if joined and first <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], last + window)
                    else:
                        joined.append([first, last + window])
                at = 0
                for a, b in joined:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                rows.append((k, th, len(data) - len(kept), len(joined), hashlib.sha256(kept).hexdigest(), joined))
            yield pd.DataFrame(rows, columns=["_key", "_th", "n_removed", "n_spans", "kept_sha256", "runs"])

    rows = texts_of(texts, runs, ["_key", "_th"]).select("_key", "_th", "text", "spans")
    return rows.mapInPandas(cut, "_key long, _th long, n_removed long, n_spans long, kept_sha256 string, runs array<array<long>>")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit("")).cast("binary")
    whole = docs.select("doc_id", key().alias("_key"), F.xxhash64("text").alias("_th"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("_whole"), F.md5(text).alias("_digest"))
    with Scope(spark) as scope:
        whole = stored(whole, "suffix-whole")
        first = stored(whole.where(F.col("n_bytes") >= WINDOW).groupBy("_digest").agg(F.min("_key").alias("_first")), "suffix-first")
        whole = stored(whole.join(first, "_digest", "left").withColumn("_copy", F.coalesce(F.col("_key") > F.col("_first"), F.lit(False))), "suffix-whole")
        copies = whole.where("_copy").groupBy("_key").agg(F.collect_set("_digest").alias("digests"))
        cut = stored(removed_bytes(docs, copies).drop("runs").dropDuplicates(["_key", "_th"]), "suffix-cut")
        scope.keep(whole, cut)
    out = whole.join(cut, ["_key", "_th"], "left")
    copy = F.col("_copy")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "_whole")).alias("kept_sha256"),
    )
