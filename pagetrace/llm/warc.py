"""WARC archives with an index: written first, read by coalesced byte ranges.

Each record is a gzip member of its own, so that a range of the file can be read
alone.  The index (Parquet, beside the archives) has file, offset, length, url,
digest, page_id and type of every record.  To read, the selected index rows are
sorted by place in each file, neighbours are joined into ranges, and every range
is fetched with one read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan
from .common import in_batches, stash

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload hashes of up to this number are broadcast, more are joined with a shuffle.
FEW_ROWS = 500_000
INDEX = "page_id long, url string, file string, offset long, length long, digest string, record_type string"


def _name(page_id: int | None, place: str = "") -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}{place and ':' + place}>"


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)(?::[\d.]+)?>", name or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, first_url: str | None, date: str, place: str = "") -> bytes:
    """One compressed record; a revisit has the HTTP head of the whole payload, but not the payload.

    place makes the record's name unique where the page_id alone doesn't: there is
    one response of a page_id, but repeated rows are several revisits.
    """
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    line = lambda s: (s or "").replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _name(page_id, place if revisit or page_id is None else "")),
        ("WARC-Date", date),
        ("WARC-Target-URI", line(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to)), ("WARC-Refers-To-Target-URI", line(first_url))]
    whole = ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(whole) + pack.flush()


def parse(member: bytes) -> dict:
    """Fields of a record and its payload (None of a revisit), with the payload's length and digest."""
    whole = zlib.decompress(member, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if not revisit:
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if own != digest or len(payload) != size:
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {"fields": fields, "payload": None if revisit else payload, "bytes": size, "digest": digest, "revisit": revisit}


def _typed(pages: DataFrame) -> DataFrame:
    """page_id, url, html, sha, revisit, refers_to, first_url of every row."""
    rows = in_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    # Only payloads that occur more than once; copies are counted before they are moved.
    each = rows.groupBy("sha", "page_id").agg(F.count("*").alias("n"), F.max("url").alias("url"))
    several = each.groupBy("sha").agg(F.sum("n").alias("copies"), F.max(F.struct("page_id", "url", "n")).alias("last")).where("copies > 1")
    several = several.select("sha", F.col("last.page_id").alias("refers_to"), F.col("last.url").alias("first_url"), F.col("last.n").alias("_tied"))
    # written first, so that the copies of one common page can be dealt to several tasks; mostly it is small and no page is moved
    several = stash(several)
    typed = rows.join(F.broadcast(several) if several.count() <= FEW_ROWS else several, "sha", "left")
    typed = typed.withColumn("revisit", F.col("_tied").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
    if not several.where("_tied > 1").isEmpty():
        # Of repeated rows of the page that is kept, the first is the response.
        typed = stash(typed.withColumn("_row", F.monotonically_increasing_id()))
        first = typed.where("_tied > 1 and not revisit").groupBy("sha").agg(F.min("_row").alias("_first"))
        first = stash(first.withColumnRenamed("sha", "_sha"))
        first = F.broadcast(first) if first.count() <= FEW_ROWS else first
        typed = typed.join(first, F.col("sha") == F.col("_sha"), "left").withColumn("revisit", F.col("revisit") | F.coalesce((F.col("_tied") > 1) & (F.col("_row") != F.col("_first")), F.lit(False)))
    return typed.select("page_id", "url", "html", "sha", "revisit", F.when(F.col("revisit"), F.col("refers_to")).alias("refers_to"), "first_url")


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archives of all rows of pages in path, and their index, which is returned.

    A null html counts as empty.  Of rows with equal payloads that with the
    largest page_id is the response (of repeated rows of that page, the first);
    the others are revisits that refer to it.
    """
    spark = pages.sparkSession
    fs, at = pafs.FileSystem.from_uri(path)
    fs.create_dir(at, recursive=True)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        file, out, offset = f"pages-{task.partitionId():05d}.warc.gz", None, 0
        count = 0
        fs, base = pafs.FileSystem.from_uri(f"{path}/{file}")
        draft = f"{base}.{task.taskAttemptId()}"
        for batch in textscan.slices(batches, "html"):
            out, done = out or fs.open_output_stream(draft), []
            for r in batch.to_pylist():
                digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                member = record(r["page_id"], r["url"], r["html"].encode(), digest, r["refers_to"], r["revisit"], r["first_url"], date, f"{task.partitionId()}.{count}")
                count += 1
                out.write(member)
                done.append((r["page_id"], r["url"], file, offset, len(member), digest, "revisit" if r["revisit"] else "response"))
                offset += len(member)
            if done:
                names = [f.split()[0] for f in INDEX.split(", ")]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
        if out is not None:
            out.close()
            fs.move(draft, base)

    _typed(pages).mapInArrow(rows, INDEX).write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def ranges(index: DataFrame, chunk: int = 8 << 20, gap: int = 64 << 10) -> DataFrame:
    """file, begin, end, records: reads of at most about `chunk` bytes that skip at most `gap` bytes between records."""
    placed = index.select("file", "offset", "length", F.floor(F.col("offset") / chunk).alias("chunk"))
    order = Window.partitionBy("file", "chunk").orderBy("offset")
    apart = F.coalesce(F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(order) > gap, F.lit(False))
    runs = placed.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(order))
    return runs.groupBy("file", "chunk", "run").agg(
        F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("length")).alias("end"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records")
    ).select("file", "begin", "end", "records")


def read(index: DataFrame, path: str, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload) of the records in index."""
    shape = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    names = [f.split()[0] for f in shape.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                fs, at = pafs.FileSystem.from_uri(f"{path}/{r['file']}")
                with fs.open_input_file(at) as f:
                    data = f.read_at(r["end"] - r["begin"], r["begin"])
                out = []
                for x in r["records"]:
                    got = parse(data[x["offset"] - r["begin"] : x["offset"] - r["begin"] + x["length"]])
                    fields = got["fields"]
                    out.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], got["bytes"], got["digest"], fields["WARC-Type"], _page(fields.get("WARC-Refers-To")), got["payload"]))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out))[: len(names)], kinds)], names)

    # The ranges are a few bytes each, but the reads behind them are not: as many tasks as there are 16 MB to read.
    tasks = -(-(index.agg(F.sum("length")).first()[0] or 0) // (16 << 20))
    return ranges(index).repartition(max(1, tasks), "file", "begin").mapInArrow(rows, shape)
