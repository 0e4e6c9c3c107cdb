"""Operator 4, token ids as a binary file format with random access.

A file holds independent zstandard frames, a seek table and a footer:

    frames      each a zstandard frame of the little-endian unsigned 32-bit ids of some documents
    seek table  a zstandard frame of two parts: for each frame (offset, size, documents, tokens) as u64
                and crc32 of its compressed bytes as u32; then for each document its token count as u64
    footer      32 bytes: magic, u32 crc32 of the seek table, u64 its size, u64 documents, four zero bytes

A reader fetches footer and seek table, then only the frames that hold the documents it wants.

Documents are range-partitioned by doc_id, so the files in order are the documents in order; each task
encodes its rows as they stream by and writes one file, under a name of its own that is renamed when
complete: a lost or doubled task leaves no half file, and the manifest names the one that counts. The start of a document is the tokens of earlier files, from running sums over
the files (one row each), and of earlier documents in its file.

Pre-tokens are remembered: a text is cut at single blanks and line feeds between other characters,
where the byte-level pre-tokenizer always cuts, and distinct pieces are encoded once per worker, many rare ones in one text.

Defined cases: a null or empty text is the end id alone; null doc_ids come first; equal doc_ids are
ordered by a hash of their text, then by text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.llm.common import fresh_path, partitions, stored, table

END_ID = 2
MAGIC = b"TLOOMTK1"
FOOTER = struct.Struct("<8sIQQ4x")
FRAME = np.dtype([("offset", "<u8"), ("size", "<u8"), ("docs", "<u8"), ("tokens", "<u8"), ("crc", "<u4")])
#: A frame is closed when it has so many tokens.
FRAME_TOKENS = 1 << 16


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PieceEncoder:
    """Whole texts to ids (little-endian u32), each distinct piece encoded once.

    Pieces are cut only before a blank, or around a line feed, that stands between two characters that
    are no white space: there the byte-level pre-tokenizer ends a token whatever surrounds it. The cuts and
    the ids of the pieces are found for many texts at once, as arrays.
    """

    #: Pieces that are remembered, and bytes in them; those used last stay.
    LIMIT, CHARACTERS = 1_500_000, 24 << 20
    #: Bytes of texts that are cut at once, and pieces that are learned in one text.
    BYTES, TOGETHER = 16 << 20, 200

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        # pieces, those used last first, and the bytes of their ids
        self.known, self.known_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        # a byte-level token has a character for each of its bytes, an added one is itself
        self.widths = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, np.int64)
        for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.widths[k] = len(token)
        for k, token in self.tokenizer.get_added_tokens_decoder().items():
            self.widths[k] = len(token.content.encode())

    def recall(self, pieces: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of distinct pieces, learned where they are new."""
        at = pc.index_in(pieces, value_set=self.known)
        new, found = at.is_null(), at.drop_null().to_numpy()
        old = ~new.to_numpy(zero_copy_only=False)
        place = np.empty(len(pieces), np.int64)
        place[old], place[~old] = found, len(self.known) + np.arange(len(pieces) - len(found))
        ids = pa.concat_arrays([self.known_ids, self.learn(pieces.filter(new))]).take(pa.array(place))
        unused = np.ones(len(self.known), bool)
        unused[found] = False
        known = pa.concat_arrays([pieces, self.known.filter(pa.array(unused))])
        n = min(self.LIMIT, int(np.searchsorted(np.cumsum(pc.binary_length(known).to_numpy()), self.CHARACTERS, "right")))
        self.known, self.known_ids = known[:n], pa.concat_arrays([ids, self.known_ids.filter(pa.array(unused))])[:n]
        return ids

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of pieces; those of a blank and no other white space are encoded many in a text and told apart by their bytes."""
        plain = plain_pieces(new)
        block = new.filter(pa.array(plain))
        bounds, data = np.concatenate([[0], np.cumsum(pc.binary_length(block).to_numpy())]), block.buffers()[2]
        text, where = data.to_pybytes() if data else b"", np.flatnonzero(plain)
        known, counts, apart = [], [], [np.flatnonzero(~plain)]
        for i in range(0, len(where), self.TOGETHER):
            ends = bounds[i : i + self.TOGETHER + 1]
            ids = self.ids([text[ends[0] : ends[-1]].decode()])[0]
            reached = np.cumsum(self.widths[ids])
            ends = ends[1:] - ends[0]
            at = np.searchsorted(reached, ends)
            if not len(reached) or reached[-1] != ends[-1] or not np.array_equal(reached[at], ends):
                apart.append(where[i : i + self.TOGETHER])  # a tokenizer that changes its text
                plain[apart[-1]] = False
                continue
            known.append(ids)
            counts.append(np.diff(at + 1, prepend=0))
        other = np.concatenate(apart)
        for ids in self.ids(new.take(pa.array(other)).to_pylist()):
            known.append(ids)
            counts.append([len(ids)])
        ends = np.concatenate([[0], *counts]).astype(np.int64).cumsum() * 4
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(new), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate([np.zeros(0, "<u4"), *known]))])
        return out.take(pa.array(np.argsort(np.concatenate([np.flatnonzero(plain), other]))))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [x.tobytes() for x in self.encoded(pa.array(texts, pa.string()))]

    def encoded(self, texts: pa.StringArray) -> Iterator[np.ndarray]:
        """The ids of each text, as many texts at once as have BYTES."""
        texts = texts.fill_null("").cast(pa.large_string())
        ends = np.cumsum(pc.binary_length(texts).to_numpy())
        begin = 0
        while begin < len(texts):
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + self.BYTES, "right")))
            yield from self.together(pa.concat_arrays([texts[begin:end]]))
            begin = end

    def together(self, texts: pa.LargeStringArray) -> Iterator[np.ndarray]:
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
        starts = cuts(np.frombuffer(data or b"", np.uint8)[: bounds[-1]], bounds)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, bounds[-1])), data).dictionary_encode()
        _, ends, ids = self.recall(pieces.dictionary).take(pieces.indices).buffers()
        ends, out = np.frombuffer(ends, np.int64, len(starts) + 1) // 4, np.frombuffer(ids or b"", "<u4")
        at = ends[np.searchsorted(starts, bounds)]
        for i in range(len(texts)):
            yield out[at[i] : at[i + 1]]


#: A blank and characters that are no white space.
_PLAIN = re.compile(r" [^\s\x1c-\x1f\x85]+").fullmatch
#: The first two bytes of characters that are white space, or may be, in UTF-8 beyond ASCII.
_WIDE = np.zeros(1 << 16, bool)
_WIDE[[0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380]] = True


def plain_pieces(pieces: pa.LargeStringArray) -> np.ndarray:
    """Which of the pieces are a blank and characters that are no white space."""
    _, offsets, data = pieces.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(pieces) + 1, pieces.offset * 8)
    padded = np.pad(np.frombuffer(data or b"", np.uint8), (0, 2))
    before = np.concatenate([[0], np.cumsum(padded <= 32)])
    out = (padded[bounds[:-1]] == 32) & (np.diff(bounds) > 1) & (before[bounds[1:]] - before[bounds[:-1]] == 1)
    before = np.concatenate([[0], np.cumsum(_WIDE[padded[:-1].astype(np.uint16) << 8 | padded[1:]])])
    for i in np.flatnonzero(out & (before[bounds[1:]] > before[bounds[:-1]])).tolist():
        out[i] = bool(_PLAIN(pieces[i].as_py()))
    return out


def cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces begin in the UTF-8 bytes of texts with these bounds; pieces do not cross them.

    White space beyond ASCII is judged by its first bytes, so that some characters pass for white space:
    next to them there is no cut, and pieces are longer.
    """
    at = np.flatnonzero((data == 32) | (data == 10))
    inside = np.ones(len(data) + 1, bool)
    inside[bounds] = False  # a text's first byte has none before it
    at = at[inside[at] & inside[at + 1]]
    at = at[(data[at - 1] > 32) & (data[at + 1] > 32)]
    padded = np.pad(data, 3)

    def pair(first: np.ndarray) -> np.ndarray:
        return padded[first + 3].astype(np.uint16) << 8 | padded[first + 4]

    at = at[~_WIDE[pair(at + 1)] & ~_WIDE[pair(at - 2)] & ~_WIDE[pair(at - 3)]]
    begins = np.zeros(len(data) + 1, bool)
    begins[bounds[:-1]] = begins[at] = begins[at[data[at] == 10] + 1] = True
    return np.flatnonzero(begins[:-1])


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def gathered(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order, in batches of about size bytes."""
    held, total = [], 0
    for batch in batches:
        if held and total + batch.nbytes > size:
            yield pa.concat_batches(held)
            held, total = [], 0
        held.append(batch)
        total += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    """Writes one file of the format to an open stream."""

    def __init__(self, sink, frame_tokens: int = FRAME_TOKENS) -> None:
        self.sink, self.frame_tokens = sink, frame_tokens
        self.packer = zstandard.ZstdCompressor(level=1)
        self.frames: list[tuple] = []
        self.counts: list[int] = []
        self.open: list[bytes] = []
        self.open_docs = self.open_tokens = self.offset = self.tokens = 0

    def add(self, ids: bytes) -> None:
        n = len(ids) // 4
        self.open.append(ids)
        self.counts.append(n)
        self.open_docs += 1
        self.open_tokens += n
        self.tokens += n
        if self.open_tokens >= self.frame_tokens:
            self.flush()

    def flush(self) -> None:
        if self.open_docs:
            data = self.packer.compress(b"".join(self.open))
            self.sink.write(data)
            self.frames.append((self.offset, len(data), self.open_docs, self.open_tokens, zlib.crc32(data)))
            self.offset += len(data)
            self.open, self.open_docs, self.open_tokens = [], 0, 0

    def close(self) -> None:
        self.flush()
        body = struct.pack("<Q", len(self.frames)) + np.array(self.frames, FRAME).tobytes() + np.array(self.counts, "<u8").tobytes()
        seek = self.packer.compress(body)
        self.sink.write(seek)
        self.sink.write(FOOTER.pack(MAGIC, zlib.crc32(seek), len(seek), len(self.counts)))


class Reader:
    """Random access to a file of the format; every checksum is verified on use."""

    def __init__(self, source, size: int) -> None:
        self.source = source
        source.seek(size - FOOTER.size)
        magic, crc, length, docs = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(size - FOOTER.size - length)
        seek = source.read(length)
        if zlib.crc32(seek) != crc:
            raise ValueError("the seek table's checksum does not match")
        body = zstandard.ZstdDecompressor().decompress(seek)
        n = struct.unpack_from("<Q", body)[0]
        self.frames = np.frombuffer(body, FRAME, n, 8)
        self.counts = np.frombuffer(body, "<u8", docs, 8 + n * FRAME.itemsize).astype(np.int64)
        self.first_doc = np.concatenate([[0], np.cumsum(self.frames["docs"].astype(np.int64))])
        self.unpacker = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> np.ndarray:
        f = self.frames[k]
        self.source.seek(int(f["offset"]))
        data = self.source.read(int(f["size"]))
        if zlib.crc32(data) != int(f["crc"]):
            raise ValueError(f"the checksum of frame {k} does not match")
        return np.frombuffer(self.unpacker.decompress(data), "<u4")

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(place in the file, ids) of the wanted documents, or of all, in order."""
        places = np.arange(len(self.counts)) if wanted is None else np.array(sorted(wanted), np.int64)
        of = np.searchsorted(self.first_doc, places, "right") - 1
        for k in np.unique(of):
            ids, begin = self.frame(int(k)), self.first_doc[k]
            ends = np.cumsum(self.counts[begin : self.first_doc[k + 1]])
            for place in places[of == k].tolist():
                end = int(ends[place - begin])
                yield place, ids[end - int(self.counts[place]) : end]


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str | None = None, end_id: int = END_ID, frame_tokens: int = FRAME_TOKENS, files: int | None = None) -> DataFrame:
    """Write doc_id and text of docs to files under folder (a URI that all tasks see).

    Returns the manifest, stored: part, path, and doc_id and place in the file of every document.
    """
    tokenizer_path = tokenizer_path or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        store, base = file_system(folder)
        store.create_dir(base, recursive=True)
        draft, name = f"{base}/.draft-{uuid.uuid4().hex}", f"part-{part:06d}-{uuid.uuid4().hex}.bin"
        n = 0
        with store.open_output_stream(draft) as sink:
            out = Writer(sink, frame_tokens)
            for batch in gathered(batches, encode.BYTES):
                for ids in encode.encoded(batch["text"]):
                    out.add(ids.tobytes() + end)
                n += len(batch)
                place = pa.array(np.arange(n - len(batch), n))
                own = [pa.array([part] * len(batch), pa.int32()), pa.array([f"{folder}/{name}"] * len(batch)), batch["doc_id"].cast(pa.int64()), place]
                yield pa.RecordBatch.from_arrays(own, ["part", "path", "doc_id", "place"])
            out.close()
        if n:
            store.move(draft, f"{base}/{name}")
        else:
            store.delete_file(draft)

    ranged = docs.select("doc_id", "text").repartitionByRange(files or partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ranged = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    return stored(ranged.mapInArrow(write, "part int, path string, doc_id long, place long"), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of a manifest, read from its files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, path in zip(batch["part"], batch["path"], strict=True):
                store, place = file_system(path)
                with store.open_input_file(place) as source:
                    reader = Reader(source, source.size())
                    begin, rows = 0, []
                    for k, ids in reader.documents():
                        rows.append((part, k, begin, len(ids), zlib.crc32(ids.tobytes())))
                        begin += len(ids)
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=["part", "place", "begin", "n_tokens", "ids_crc32"])
                            rows = []
                    yield pd.DataFrame(rows, columns=["part", "place", "begin", "n_tokens", "ids_crc32"])

    spark = manifest.sparkSession
    files = manifest.select("part", "path").distinct().repartition(partitions(spark), "path")
    found = stored(files.mapInPandas(read, "part int, place long, begin long, n_tokens long, ids_crc32 long"), "token-read")
    # one row per file: running sums over them make the starts
    sums = found.groupBy("part").agg(F.sum("n_tokens").alias("_tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("_tokens").over(earlier), F.lit(0)).alias("_before"))
    out = manifest.select("part", "doc_id", "place").join(found, ["part", "place"]).join(sums, "part")
    return out.select("doc_id", (F.col("_before") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def encoded_and_read(docs: DataFrame) -> DataFrame:
    return read_tokens(write_tokens(docs, fresh_path(docs.sparkSession, "tokens")))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_and_read(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encoded_and_read(docs)
