"""Token ids in binary files, each document compressed by itself with a shared dictionary.

A store is a folder of
  dictionary        a zstandard dictionary, trained on serialized id arrays
  part-NNNNN.tok    zstandard frames, one for each document, in doc_id order
  part-NNNNN.idx    HEADER, then an ENTRY for each frame
Parts are in doc_id order too.  The header carries the dictionary's SHA-256, so
that a frame is never read with another; offset and length of an entry reach a
single short document without its neighbours.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textscan
from .common import in_batches, stash
from .wordbpe import encoding

MAGIC = b"PTTOKEN1"
HEADER = np.dtype([("magic", "S8"), ("dictionary", "V32"), ("count", "<u8")])
ENTRY = np.dtype([("doc_id", "<i8"), ("null_id", "u1"), ("width", "u1"), ("offset", "<u8"), ("length", "<u8"), ("n_tokens", "<u8")])
DICTIONARY, SAMPLE, SAMPLE_BYTES = 64 << 10, 1500, 16 << 10


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def write_file(path: str, data: bytes) -> None:
    """Whole or not at all: a retried task replaces what its first attempt left."""
    fs, at = _fs(path)
    task = TaskContext.get()
    draft = f"{at}.{task.taskAttemptId() if task else 'driver'}"
    with fs.open_output_stream(draft) as out:
        out.write(data)
    fs.move(draft, at)


def read_file(path: str) -> bytes:
    fs, at = _fs(path)
    with fs.open_input_stream(at) as f:
        return f.readall()


def _serialized(ids: np.ndarray) -> tuple[bytes, int]:
    width = 2 if ids.max(initial=0) < 1 << 16 else 4
    return ids.astype(f"<u{width}").tobytes(), width


def train(docs: DataFrame, vocabulary: str, end: int) -> bytes:
    """The dictionary's bytes; from the SAMPLE texts of up to SAMPLE_BYTES with the least hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, at in encoding(vocabulary, batches):
            yield pa.RecordBatch.from_arrays([pa.array([_serialized(np.r_[ids[i:j], np.uint32(end)])[0] for i, j in zip(at, at[1:])], pa.binary())], ["ids"])

    some = docs.where(F.octet_length("text") <= SAMPLE_BYTES).select("text", F.xxhash64("doc_id", "text").alias("_h")).orderBy("_h").limit(SAMPLE).select("text")
    samples = [bytes(r["ids"]) for r in some.mapInArrow(rows, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the samples themselves
        return b"".join(samples)[:DICTIONARY]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def write(docs: DataFrame, path: str, vocabulary: str, end: int = 2, part_bytes: int = 32 << 20) -> DataFrame:
    """Writes a store of all rows of docs; returns part, file, docs, tokens for each part.

    A null text counts as empty.  Rows are in the order of doc_id (nulls first),
    those with one doc_id in the order of a hash of their text.  There are as many
    parts as there are `part_bytes` bytes of text, whatever the session's settings.
    """
    raw = train(docs, vocabulary, end)
    _fs(path)[0].create_dir(_fs(path)[1], recursive=True)
    write_file(f"{path}/dictionary", raw)
    mark = hashlib.sha256(raw).digest()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        found = _dictionary(raw)
        packer = zstandard.ZstdCompressor(level=3, dict_data=found) if found else zstandard.ZstdCompressor(level=3)
        entries, at, tokens, out = [], 0, 0, None
        fs, base = _fs(f"{path}/part-{part:05d}")
        draft = f"{base}.{TaskContext.get().taskAttemptId()}"
        for batch, ids, begin in encoding(vocabulary, batches):
            out = out or fs.open_output_stream(draft)
            for doc_id, i, j in zip(batch.column("doc_id").to_pylist(), begin, begin[1:]):
                data, width = _serialized(np.r_[ids[i:j], np.uint32(end)])
                frame = packer.compress(data)
                out.write(frame)
                entries.append((doc_id or 0, doc_id is None, width, at, len(frame), j - i + 1))
                at += len(frame)
                tokens += int(j - i + 1)
        if out is None:
            return
        out.close()
        head = np.array([(MAGIC, mark, len(entries))], HEADER)
        write_file(f"{path}/part-{part:05d}.idx", head.tobytes() + np.array(entries, ENTRY).tobytes())
        fs.move(draft, f"{base}.tok")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([f"part-{part:05d}"]), pa.array([len(entries)], pa.int64()), pa.array([tokens], pa.int64())], ["part", "file", "docs", "tokens"])

    wanted = in_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # few bytes still go to all cores, a megabyte each at least
    parts = max(1, -(-size // part_bytes), min(docs.sparkSession.sparkContext.defaultParallelism, size >> 20))
    ordered = wanted.repartitionByRange(parts, "doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    return stash(ordered.mapInArrow(rows, "part long, file string, docs long, tokens long"))


def _index(path: str, file: str, mark: bytes) -> np.ndarray:
    data = read_file(f"{path}/{file}.idx")
    head = np.frombuffer(data, HEADER, 1)[0]
    if head["magic"] != MAGIC or bytes(head["dictionary"]) != mark:
        raise ValueError(f"{path}/{file}.idx was not written with this dictionary")
    return np.frombuffer(data, ENTRY, int(head["count"]), HEADER.itemsize)


def _unpacker(path: str) -> tuple[zstandard.ZstdDecompressor, bytes]:
    raw = read_file(f"{path}/dictionary")
    found = _dictionary(raw)
    return (zstandard.ZstdDecompressor(dict_data=found) if found else zstandard.ZstdDecompressor()), hashlib.sha256(raw).digest()


def read(parts: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a store, from its files.

    parts: what write() returned, one row for each file.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = parts.select("part", "file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    files = files.repartition(max(1, parts.count()), "part")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = None
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                if unpack is None:
                    unpack, mark = _unpacker(path)
                index = _index(path, file, mark)
                fs, at = _fs(f"{path}/{file}.tok")
                starts = base + np.cumsum(index["n_tokens"]).astype(np.int64) - index["n_tokens"].astype(np.int64)
                with fs.open_input_stream(at, buffer_size=1 << 20) as f:
                    for i in range(0, len(index), 2000):
                        part, sizes, crc = index[i : i + 2000], [], []
                        for e in part:
                            ids = np.frombuffer(unpack.decompress(f.read(int(e["length"]))), f"<u{e['width']}").astype("<u4")
                            sizes.append(len(ids))
                            crc.append(zlib.crc32(ids.data.cast("B")))
                        yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"], mask=part["null_id"].astype(bool)), pa.array(starts[i : i + 2000]), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(parts: DataFrame, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id, ids of the documents whose doc_id is in wanted: only their byte ranges are read."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                index = _index(path, file, _unpacker(path)[1])
                index = index[index["null_id"] == 0]
                yield pa.RecordBatch.from_arrays([pa.array(index["doc_id"]), pa.array([file] * len(index)), pa.array(index["width"].astype(np.int32)), *(pa.array(index[c].astype(np.int64)) for c in ("offset", "length"))], ["doc_id", "file", "width", "offset", "length"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _unpacker(path)[0]
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                fs, at = _fs(f"{path}/{r['file']}.tok")
                with fs.open_input_file(at) as f:
                    out.append(np.frombuffer(unpack.decompress(f.read_at(r["length"], r["offset"])), f"<u{r['width']}").astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    index = parts.select("file").mapInArrow(entries, "doc_id long, file string, width int, offset long, length long")
    return index.join(wanted.select("doc_id").distinct(), "doc_id").mapInArrow(rows, "doc_id long, ids array<int>")


def stored(docs: DataFrame, spark: SparkSession, path: str, vocabulary: str, end: int = 2) -> DataFrame:
    """Write docs to a store at path and read it back."""
    return read(write(docs, path, vocabulary, end), path)
