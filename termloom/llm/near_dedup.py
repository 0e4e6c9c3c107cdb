"""Operator 5, MinHash near-dedup with sequential Bayesian verification.

1. Every text becomes a set of hashed word shingles, of which the bands of a signature of minima and a
   digest are kept. Texts with equal sets form one class, collapsed by partial aggregation: copies never
   meet in pairs, and a class goes on as its first row.
2. Classes that share a band meet in a bucket. A class's weight is the size of all its buckets together; the
   original of a group of edited copies has the largest. LEADERS times every class is paired with one class
   alone, the heaviest leader among its buckets, at first the heaviest member, then the heaviest outside
   the bucket's largest component. That links nearly all there is to link, with a row a class.
3. Classes that share a bucket and are still apart are compared in blocks: the members outside the bucket's largest
   component meet all members, in chunks of about CHUNK_BYTES. A pair is compared in the first band that it
   shares alone, inside a task, and no pair becomes a row: a block returns the links that join what was
   apart. Pairs inside a component are left out, as they can't change the result; no other is.
4. Both compare signatures batch by batch, on the low byte of each minimum. With m of n bytes equal and a
   uniform prior the posterior of the chance that bytes are equal is Beta(m + 1, n - m + 1); the pair is
   dropped once the posterior probability of reaching the threshold is below the chosen miss probability.
   Survivors are verified on their full sets; verified links make the components.

Defined cases: a text without words has an empty set, is linked with nothing and its own component; fewer
words than a shingle make one shingle of the whole sequence; repeated rows are copies of each other; rows
without a doc_id link as any others, their component's id is the smallest doc_id in it, or null where
there is none; rows of one doc_id with several texts are documents of their own; an empty table gives an
empty result; other columns are not read (stage() carries them).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.llm.common import Scope, encoded, mixed, rolled, stored, table, texts_of, word_hashes

HASHES, BATCH = 256, 32
MISS = 1e-6
#: Most that banding may miss of the pairs whose similarity is exactly the threshold.
BAND_MISS = 3e-4
LEADERS, CHUNK_BYTES = 2, 1 << 20
#: Pairs of a block that are compared at once.
PAIRS = 100_000
_RANDOM = np.random.default_rng(20240229)
_A = _RANDOM.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _RANDOM.integers(0, 2**32, HASHES, dtype=np.uint32)


def shingle_set(text: str | bytes | None, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles (A-Z lower-cased)."""
    words = (text if isinstance(text, bytes) else encoded(text)).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(shingle, len(words))
    return np.unique(mixed(rolled(word_hashes(words), k) + np.uint64(k)))


def signature(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 2048):
        out = np.minimum(out, (np.multiply.outer(_A, x[i : i + 2048]) + _B[:, None]).min(axis=1))
    return out


@lru_cache
def band_rows(threshold: float) -> int:
    """The most rows of a band, and so the fewest chance meetings, that banding at BAND_MISS allows."""
    return max(r for r in range(1, 17) if r == 1 or (1 - threshold**r) ** (HASHES // r) <= BAND_MISS)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """The keys of the bands of a signature, or of each row of a matrix of signatures."""
    bands = HASHES // rows
    values = sig[..., : bands * rows].reshape(*sig.shape[:-1], bands, rows).astype(np.uint64)
    out = np.arange(bands, dtype=np.uint64)
    for j in range(rows):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + values[..., j])
    return out.view(np.int64)


def text_key():
    """Names a text beside its doc_id."""
    return F.md5(F.col("text").cast("binary")).alias("th")


def signed(docs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """rid, doc_id, th, n_shingles, digest of the set and bands; one row per row of docs."""
    rows = band_rows(threshold)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                s = shingle_set(text, shingle)
                out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), band_keys(signature(s), rows)) if len(s) else (0, None, None))
            out = pd.DataFrame(out, columns=["n_shingles", "digest", "bands"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            out.insert(1, "th", batch["th"].to_numpy(dtype=object))
            yield out

    rows_of = docs.select(F.col("doc_id").cast("long"), text_key(), "text").mapInPandas(sign, "doc_id long, th string, n_shingles long, digest binary, bands array<long>")
    return rows_of.withColumn("rid", F.monotonically_increasing_id())


def packed(docs: DataFrame, members: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """cid, sig (low bytes of the minima), bands (4 bytes each) and z (the text, compressed) of the members.

    members: cid, doc_id, th, digest.
    """
    rows = band_rows(threshold)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            out = []
            for cid, text, digest in zip(batch["cid"], batch["text"], batch["digest"], strict=True):
                s = shingle_set(text, shingle)
                if xxhash.xxh3_128_digest(s.tobytes()) == digest:
                    sig = signature(s)
                    out.append((cid, sig.astype(np.uint8).tobytes(), band_keys(sig, rows).astype(np.uint32).tobytes(), packer.compress(encoded(text))))
            yield pd.DataFrame(out, columns=["cid", "sig", "bands", "z"])

    texts = texts_of(docs.select(F.col("doc_id").cast("long"), text_key(), "text"), members, ["doc_id", "th"])
    out = texts.select("cid", "text", "digest").mapInPandas(pack, "cid long, sig binary, bands binary, z binary")
    # rows equal in doc_id and text come as often as there are such rows
    return out.groupBy("cid").agg(F.first(F.struct("sig", "bands", "z")).alias("_p")).select("cid", "_p.*")


@lru_cache
def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest equal bytes of n that leave the threshold a posterior probability of miss or more."""
    equal = threshold + (1 - threshold) / 256  # the low bytes of different minima may be equal
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * equal**m * (1 - equal) ** (n + 1 - m)
        if total >= miss:
            return m
    return n + 1


def undropped(left: np.ndarray, right: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float, miss: float = MISS) -> np.ndarray:
    """Numbers of the pairs (left[x], right[y]) that the sequential comparison does not drop."""
    alive, equal = np.arange(len(x)), np.zeros(len(x), np.int64)
    for n in range(BATCH, HASHES + 1, BATCH):
        equal = equal + (left[x[alive], n - BATCH : n] == right[y[alive], n - BATCH : n]).sum(axis=1)
        keep = equal >= least_matches(n, threshold, miss)
        alive, equal = alive[keep], equal[keep]
    return alive


def reaches(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def bytes_of(column, width: int, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(-1, width)


def linked(pairs: DataFrame, pack: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that the sequential comparison doesn't drop and the full sets confirm."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor().decompress
        last, theirs = None, None
        for batch in batches:
            if not len(batch):
                continue
            own, keep = np.arange(len(batch)), []
            for i in undropped(bytes_of(batch["sa"], HASHES), bytes_of(batch["sb"], HASHES), own, own, percent / 100).tolist():
                if batch["b"].iat[i] != last:
                    last, theirs = batch["b"].iat[i], shingle_set(unpack(batch["zb"].iat[i]), shingle)
                if reaches(shingle_set(unpack(batch["za"].iat[i]), shingle), theirs, percent):
                    keep.append(i)
            yield batch.iloc[keep][["a", "b"]]

    def side(name: str) -> DataFrame:
        return pack.select(F.col("cid").alias(name), F.col("sig").alias(f"s{name}"), F.col("z").alias(f"z{name}"))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb", "za", "zb").mapInPandas(compare, "a long, b long")


def joined(labels: np.ndarray, labels2: np.ndarray, x: np.ndarray, y: np.ndarray, confirm) -> list[int]:
    """Numbers of confirmed pairs (x, y) that join what was apart; pairs that are joined meanwhile are not asked."""
    parent = {v: v for v in {*labels.tolist(), *labels2.tolist()}}

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    out = []
    for k, (i, j) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        a, b = root(int(labels[i])), root(int(labels2[j]))
        if a != b and confirm(i, j):
            parent[a] = b
            out.append(k)
    return out


def linked_in_blocks(members: DataFrame, pack: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) between members of a bucket with different labels, enough of them to join all that links join.

    members: key, cid, size, label, major (the bucket's largest component).
    """
    threshold = percent / 100
    rows = band_rows(threshold)
    n_bands = HASHES // rows

    def unpacked(block: pa.StructArray) -> list:
        return [*(block.field(c).to_numpy() for c in ("cid", "label", "size")), bytes_of(block.field("sig").to_pylist(), HASHES), bytes_of(block.field("bands").to_pylist(), n_bands, np.uint32), block.field("z").to_pylist()]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for key, major, xs, ys in zip(batch["key"].to_pylist(), batch["major"].to_pylist(), batch["xs"], batch["ys"], strict=True):
                (ids, labels, sizes, sig, bands, z), (ids2, labels2, sizes2, sig2, bands2, z2) = unpacked(xs.values), unpacked(ys.values)
                own = int(np.flatnonzero(bands[0] == np.int64(key).astype(np.uint32))[0])
                sets, sets2 = lru_cache(None)(lambda i: shingle_set(unpack(z[i]), shingle)), lru_cache(None)(lambda j: shingle_set(unpack(z2[j]), shingle))  # noqa: B023
                left, right = [], []
                for at in np.array_split(np.arange(len(ids)), min(len(ids), len(ids) * len(ids2) // PAIRS + 1)):
                    apart = labels[at, None] != labels2
                    apart &= (labels2 == major) | (ids[at, None] < ids2)  # both outside the largest: once
                    apart &= 100 * np.minimum(sizes[at, None], sizes2) >= percent * np.maximum(sizes[at, None], sizes2)
                    x, y = np.nonzero(apart)
                    x = at[x]
                    fresh = ~(bands[x, :own] == bands2[y, :own]).any(axis=1)
                    x, y = x[fresh], y[fresh]
                    keep = undropped(sig, sig2, x, y, threshold)
                    left.append(x[keep])
                    right.append(y[keep])
                x, y = np.concatenate(left), np.concatenate(right)
                found = joined(labels, labels2, x, y, lambda i, j: reaches(sets(i), sets2(j), percent))  # noqa: B023
                if found:
                    yield pa.record_batch({"a": pa.array(ids[x[found]], pa.int64()), "b": pa.array(ids2[y[found]], pa.int64())})

    sized = members.join(pack.select("cid", (F.lit(HASHES + 4 * n_bands) + F.octet_length("z")).alias("_bytes")), "cid")
    bulk = sized.groupBy("key").agg(F.sum("_bytes").alias("_all"), F.sum(F.when(F.col("label") != F.col("major"), F.col("_bytes"))).alias("_outside"))
    bulk = stored(bulk, "near-bulk")

    def chunk(total: str):
        return F.pmod(F.xxhash64("cid"), F.ceil(F.col(total) / CHUNK_BYTES))

    # members are dealt into chunks before they get their texts, which are shuffled for the chunks alone
    dealt = stored(members.join(bulk, "key").select(*members.columns, chunk("_outside").alias("_x"), chunk("_all").alias("_y")), "near-chunks")
    full = dealt.join(pack, "cid")
    gathered = F.collect_list(F.struct("cid", "label", "size", "sig", "bands", "z"))
    one = full.where("label != major").groupBy("key", "major", "_x").agg(gathered.alias("xs")).drop("_x")
    other = full.groupBy("key", "_y").agg(gathered.alias("ys")).drop("_y")
    return one.join(other, "key").select("key", "major", "xs", "ys").mapInArrow(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node reachable) for the nodes of links (a, b) but the labels themselves, by large and small stars; stored.

    Each side of a join on a node is a stored table, so that Spark can split a hub's rows.
    """
    with Scope(links.sparkSession) as scope:
        edges = stored(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        while True:
            both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
            large = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
            scope.drop(edges, least)
            least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
            small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            edges = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
            scope.drop(large, least)
            ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
            # done when all are stars: a node points to one other at most, and none points to a node that points on
            if ends.groupBy("n").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").isEmpty():
                scope.keep(edges)
                return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def classes_and_rows(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Stored: the rows (rid, doc_id, th, n_shingles, digest), and the classes (digest, cid, label).

    cid is the least rid of a class, label the least cid that links reach.
    """
    with Scope(docs.sparkSession) as scope:
        whole = stored(signed(docs, shingle, percent / 100), "near-signed")
        first = F.min_by(F.struct("doc_id", "th", F.col("n_shingles").cast("int").alias("size"), "bands"), "rid")
        classes = whole.where("digest IS NOT NULL").groupBy("digest").agg(F.min("rid").alias("cid"), first.alias("_r")).select("digest", "cid", "_r.*")
        classes = stored(classes, "near-classes")
        rows = stored(whole.drop("bands"), "near-rows")
        scope.drop(whole)
        exploded = classes.select("cid", "size", F.explode("bands").alias("key"))
        shared = stored(exploded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-keys")
        weight = F.sum("n").over(Window.partitionBy("cid"))  # a class has as many rows as bands
        buckets = stored(exploded.join(shared, "key").select("key", "cid", "size", weight.alias("weight")), "near-buckets")
        members = classes.join(buckets.select("cid").distinct(), "cid").select("cid", "doc_id", "th", "digest")
        pack = stored(packed(docs, members, shingle, percent / 100), "near-packed")
        slim = stored(classes.select("digest", "cid"), "near-classes")
        scope.drop(shared, classes)

        here = buckets.select("key", "cid", "size", "weight", F.col("cid").alias("label"), F.lit(None).cast("long").alias("major"))
        links = labels = None
        for turn in range(LEADERS + 1):
            if turn < LEADERS:
                outside = here.where(F.col("major").isNull() | (F.col("label") != F.col("major")))
                leaders = outside.groupBy("key").agg(F.max_by(F.struct("weight", "cid", "size", "label"), F.struct("weight", -F.col("cid"))).alias("_l"))
                leaders = stored(leaders, "near-leaders")
                # sets of sizes too far apart can't reach the threshold
                near = F.lit(100) * F.least("size", "_l.size") >= percent * F.greatest("size", "_l.size")
                pairs = here.join(leaders, "key").where((F.col("label") != F.col("_l.label")) & near)
                pairs = pairs.groupBy(F.col("cid").alias("a")).agg(F.max_by("_l.cid", F.struct("_l.weight", -F.col("_l.cid"))).alias("b"))
                found = stored(linked(pairs, pack, shingle, percent), "near-links")
            else:
                found = stored(linked_in_blocks(here, pack, shingle, percent), "near-links")
            if not found.isEmpty():
                links = found if links is None else links.union(found)
                labels = components(links)
            if turn == LEADERS:
                break
            scope.drop(here)
            here = buckets if labels is None else buckets.join(labels.withColumnRenamed("node", "cid"), "cid", "left")
            here = here.select("key", "cid", "size", "weight", (F.col("cid") if labels is None else F.coalesce("label", "cid")).alias("label"))
            own = here.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
            apart = own.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.count(F.lit(1)).alias("_labels")).where("_labels > 1")
            here = stored(here.join(stored(apart.select("key", "major"), "near-apart"), "key"), "near-members")
            if here.isEmpty():
                break
        if labels is not None:
            slim = stored(slim.join(labels, slim["cid"] == labels["node"], "left").select("digest", "cid", F.coalesce("label", "cid").alias("label")), "near-labelled")
        else:
            slim = stored(slim.withColumn("label", F.col("cid")), "near-labelled")
        scope.keep(rows, slim)
        return rows, slim


def linked_components(docs: DataFrame, shingle: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id; one row per row of docs (doc_id, text)."""
    rows, classes = classes_and_rows(docs, shingle, percent)
    with Scope(docs.sparkSession) as scope:
        # the smallest doc_id of each class, then of each component
        own = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("_id"))
        own = stored(classes.join(own, "digest"), "near-least")
        least = stored(own.groupBy("label").agg(F.min("_id").alias("component_id")), "near-least")
        known = stored(own.join(least, "label").select("digest", "component_id"), "near-components")
        scope.keep(known)
    out = rows.select("doc_id", "n_shingles", "digest").join(known, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linked_components(table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, columns unchanged (five words, 0.8).

    It is the one with the smallest doc_id; rows without one come last, of equal ones the first stays. A row is
    judged by its own text: other rows of the same doc_id, or of none, keep or lose theirs. Rows without words stay.
    """
    with Scope(spark) as scope:
        rows, classes = classes_and_rows(docs, 5, 80)
        known = stored(rows.where("digest IS NOT NULL").join(classes.select("digest", "label"), "digest").select("label", "rid", "doc_id", "th"), "near-rows")
        order = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "rid")
        groups = known.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("doc_id", "th"), order).alias("_best")).where("n > 1")
        several = known.join(stored(groups, "near-groups"), "label")
        # named by doc_id and text: rows to go, and rows that stay once although they come again
        marks = several.groupBy("doc_id", "th").agg(F.first(F.col("doc_id").eqNullSafe(F.col("_best.doc_id")) & (F.col("th") == F.col("_best.th"))).alias("_best"), F.count(F.lit(1)).alias("n"))
        marks = stored(marks.where("NOT _best OR n > 1").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "_best"), "near-marks")
        scope.keep(marks)
    named = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc"), text_key())
    met = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    out = named.join(marks, met, "left_anti").select("_row")
    if not marks.where("_best").isEmpty():
        again = named.join(marks.where("_best"), met).groupBy("_doc", "th").agg(F.first("_row").alias("_row"))
        out = out.union(again.select("_row"))
    return out.select("_row.*")
