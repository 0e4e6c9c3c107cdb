"""Helpers that the operators share: reading tables, shared storage, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words: blank, \t \n \v \f \r.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and every executor see: the one that the session names in spark.checkpoint.dir.

    Where none is set, as in tests, a temporary folder is made and set, on a local master only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        found = context._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
            context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='termloom-')}")
            found = context._jsc.sc().getCheckpointDir()
        base = found.get()
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/termloom/{name}-{uuid.uuid4().hex}"


#: Python workers get Arrow batches of 8 MB, as several may run at once in an executor; shuffle files go when
#: the table that was made of them is written, not when the driver happens to collect its garbage.
STORING = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def storing(spark: SparkSession) -> Iterator[None]:
    """While it holds, the session has the settings STORING."""
    before = {name: spark.conf.get(name, None) for name in STORING}
    for name, value in STORING.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


#: The open scopes, the innermost last.
_SCOPES: ContextVar[tuple["Scope", ...]] = ContextVar("scopes", default=())


def delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scope:
    """Tables stored while it is open are deleted when it closes, but for those that it keeps.

    A kept table passes to the scope around it; without one it stays until release().
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> "Scope":
        self.token = _SCOPES.set((*_SCOPES.get(), self))
        return self

    def __exit__(self, *_) -> None:
        _SCOPES.reset(self.token)
        self.drop(*[df for df, _ in self.tables])

    def drop(self, *tables: DataFrame | None) -> None:
        for df in tables:
            for entry in [x for x in self.tables if x[0] is df]:
                self.tables.remove(entry)
                delete(self.spark, entry[1])

    def keep(self, *tables: DataFrame) -> None:
        for df in tables:
            for entry in [x for x in self.tables if x[0] is df]:
                self.tables.remove(entry)
                outer = _SCOPES.get()[: _SCOPES.get().index(self)]
                if outer:
                    outer[-1].tables.append(entry)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with storing(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _SCOPES.get():
        _SCOPES.get()[-1].tables.append((out, path))
    return out


def release(spark: SparkSession) -> None:
    """Delete what stored() has left in the shared folder (call when the results are consumed)."""
    delete(spark, f"{shared_dir(spark)}/termloom")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts; sizes the shuffles that carry them."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


#: Up to so many keys (8 bytes each) a filter on texts is broadcast before they are shuffled to their join.
BROADCAST_KEYS = 4_000_000


def texts_of(docs: DataFrame, wanted: DataFrame, names: list[str]) -> DataFrame:
    """docs joined with wanted on the named columns, null-safe.

    What wanted lacks is filtered out by a broadcast hash of the names, where those are few enough, before
    the texts are shuffled; the join is exact in any case.
    """
    name = F.xxhash64(*names)
    keys = wanted.select(name.alias("_k")).distinct()
    if keys.count() <= BROADCAST_KEYS:
        docs = docs.join(F.broadcast(keys), name == F.col("_k"), "left_semi")
    other = wanted.withColumnsRenamed({n: f"_w{n}" for n in names})
    met = F.lit(True)
    for n in names:
        met = met & F.col(n).eqNullSafe(F.col(f"_w{n}"))
    return docs.join(other, met).drop(*[f"_w{n}" for n in names])


def words_column(text) -> "F.Column":
    """The words [^\\x20\\x09-\\x0D]+ of a text column as an array (null or blank text: empty)."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE))


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered per Python worker up to LIMIT words."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values (the murmur3 finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive values of h, by doubling (log k vector operations)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    parts, done, span, block = None, 0, 1, h
    multiplier = 0x9E3779B97F4A7C15
    power = multiplier
    while True:
        if k & span:
            piece = block[done : done + n]
            parts = piece.copy() if parts is None else mixed(parts * np.uint64(0xD6E8FEB86659FD93) + piece)
            done += span
        span *= 2
        if span > k:
            return mixed(parts)
        block = mixed(block[: len(block) - span // 2] * np.uint64(power | 1) + block[span // 2 :])
        power = power * multiplier % 2**64


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values, by doubling."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, h.dtype)
    span, block = 1, h
    while span * 2 <= w:
        block = np.minimum(block[:-span], block[span:])
        span *= 2
    return np.minimum(block[:n], block[w - span : w - span + n])


def merged(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Sorted starts of stretches of one length -> maximal disjoint [begin, end) runs."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > length)
    begins = np.concatenate([starts[:1], starts[breaks + 1]])
    ends = np.concatenate([starts[breaks], starts[-1:]]) + length
    return list(zip(begins.tolist(), ends.tolist(), strict=True))
