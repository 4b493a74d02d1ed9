"""Operator 9: WARC archives with a two-level capture index.

Spark's text sink writes the archives, so they land through its committer in any
store that Spark reaches, and are named ``.warc.gz`` then.  Each record is one
gzip member.  The sink ends a row with its line separator, here NUL.  A member
ends in its length, whose last byte is 0 below 16 MiB; the separator stands for
it.  After a longer one NUL is padding between members, which gzip permits.
Rows hold members of about ROW_BYTES, and files as many rows as keep them within
FILE_BYTES.  The captures are read back through the index: tasks search its
blocks for the wanted keys and read the records' ranges.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch_dir, written

LEVEL = 3
ROW_BYTES = 1 << 20
#: A file is no longer, unless one record is.
FILE_BYTES = 128 << 20
BLOCK_CAPTURES = 1000
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PREFIX = "urn:linkgrain:page:"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _clean(value: str) -> str:
    return re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id, url: str | None, payload: bytes, original) -> bytes:
    """A WARC/1.1 record: a response, or a revisit of ``original`` without the payload."""
    revisit = original is not None
    body = HTTP if revisit else HTTP + payload
    digest = sha1_base32(payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{PREFIX}{page_id}/{digest}>",
        *([f"WARC-Target-URI: {_clean(url)}"] if url is not None else []),
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <{PREFIX}{original}/{digest}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def read_records(data: bytes):
    """(offset, length, headers, payload) of the records in an archive file's bytes."""
    at = 0
    while True:
        while at < len(data) and not data[at]:  # padding
            at += 1
        if at >= len(data):
            return
        z, parts, pos = zlib.decompressobj(31), [], at
        while not z.eof:
            if pos >= len(data):
                raise ValueError("a gzip member is cut short")
            parts.append(z.decompress(data[pos : pos + (1 << 16)]))
            pos += 1 << 16
        end = min(pos, len(data)) - len(z.unused_data)
        head, _, body = b"".join(parts).partition(b"\r\n\r\n")
        headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield at, end - at, headers, body[: int(headers["Content-Length"])].partition(b"\r\n\r\n")[2]
        at = end


def page_of(value: str | None) -> str | None:
    """The page in a record's id, which ends in a slash and the payload's digest."""
    return value[len(PREFIX) + 1 : -1].rpartition("/")[0] if value else None


def surt(url: str | None) -> str:
    """Reversed-host key: ``com,example)/path?query``; lower-case host without ``www.`` or port."""
    try:
        parts = urlsplit(url or "", allow_fragments=False) if url and "]" not in url and "[" not in url else None
    except ValueError:  # a host that NFKC would change
        parts = None
    host = (parts.hostname or "") if parts else ""
    host = host.removeprefix("www.")
    if not host:
        # Tabs part the fields of a block.
        return ")" + (url or "").replace("\t", "%09")
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def revisits(pages: DataFrame, id_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """(page_id, same, refers_to), once each, of pages whose payload, with the hash ``same``, a page with a smaller id has."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    ids = pages.select(F.col(id_col).alias("page_id"), F.sha2(payload, 256).alias("_same"), F.length(payload).alias("_n"))
    ids = ids.filter(F.col("_n") >= min_bytes).drop("_n")
    first = ids.groupBy("_same").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_c")).filter("_c > 1").drop("_c")
    return ids.join(first, "_same").filter(F.col("page_id") != F.col("refers_to")).select("page_id", F.col("_same").alias("same"), "refers_to").distinct()


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> str:
    """Writes a record per row as ``.warc.gz`` part files under ``path``; returns ``path``.

    Of records with equal payloads of at least ``min_bytes`` bytes the one with
    the smallest id is a response and the others revisit it; smaller payloads
    are all responses.  A null html is an empty payload and a null url leaves
    the target header out.  Rows with one id and one payload that are repeated
    are all responses if theirs is the smallest id; rows with one id and other
    payloads are told apart by their payloads.  Null ids are kept, as
    responses.  A record's id names page and payload.  Pages of more than
    ROW_BYTES have files of their own, so that they do not make others' smaller.  Executors write through Spark's sink alone.
    """
    again = revisits(pages, id_col, html_col, min_bytes)
    same = F.sha2(F.coalesce(F.col(html_col), F.lit("")).cast("binary"), 256).alias("same")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), same).join(again, ["page_id", "same"], "left").drop("same")

    def run(batches):
        row: list[bytes] = []
        for batch in batches:
            for page_id, url, html, original in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                row.append(member(record(page_id, url, (html or "").encode(), original)))
                if sum(map(len, row)) >= ROW_BYTES:
                    yield out(row)
                    row = []
        if row:
            yield out(row)

    def out(row):
        # The separator stands for the last byte where that is 0.
        return pa.RecordBatch.from_arrays([pa.array([b"".join(row).removesuffix(b"\0")], pa.binary())], ["members"])

    size = F.coalesce(F.octet_length("html"), F.lit(0))
    largest = pages.agg(F.max(F.octet_length(F.col(html_col)))).first()[0] or 0
    parts = [(rows, largest)] if largest <= ROW_BYTES else [(rows.filter(size <= ROW_BYTES), ROW_BYTES), (rows.filter(size > ROW_BYTES), largest)]
    for part, most in parts:
        rows_per_file = max(1, FILE_BYTES // (ROW_BYTES + most))
        part.mapInArrow(run, "members binary").select(F.col("members").cast("string").alias("value")).write.mode("append").option("lineSep", "\0").option("maxRecordsPerFile", rows_per_file).text(path)
    named_archives(pages.sparkSession, path)
    return path


def named_archives(spark, path: str) -> None:
    """Gives the sink's part files the archives' extension."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in store.listStatus(folder):
        file = status.getPath()
        if file.getName().startswith("part-"):
            store.rename(file, spark._jvm.org.apache.hadoop.fs.Path(folder, file.getName().removesuffix(".txt") + ".warc.gz"))


def read_warc(spark, path: str, id_type: T.DataType) -> DataFrame:
    """A row per record of the archives: page_id, url, record_type, refers_to, payload_digest, n_bytes (stored), file, offset, length, sound.

    ``sound``: a response's digest is that of the payload read.
    """

    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column(0), batch.column(1), strict=True):
                yield _batch([_row(file.as_py(), at, n, h, payload) for at, n, h, payload in read_records(memoryview(data.as_buffer()).tobytes())])

    return _named(_archives(spark, path).mapInArrow(run, RECORD), id_type)


RECORD = "page string, url string, record_type string, refers string, payload_digest string, stored_bytes bigint, sound boolean, file string, offset bigint, length bigint"
_ARROW = pa.schema([*[(n, pa.string()) for n in ("page", "url", "record_type", "refers", "payload_digest")], ("stored_bytes", pa.int64()), ("sound", pa.bool_()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _row(file: str, at: int, n: int, h: dict, payload: bytes) -> tuple:
    digest = h.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    kind = h.get("WARC-Type")
    return page_of(h.get("WARC-Record-ID")), h.get("WARC-Target-URI"), kind, page_of(h.get("WARC-Refers-To")), digest, len(payload) if kind == "response" else None, kind != "response" or sha1_base32(payload) == digest, file, at, n


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)] if rows else [pa.array([], f.type) for f in _ARROW], schema=_ARROW)


def _archives(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def _named(got: DataFrame, id_type: T.DataType) -> DataFrame:
    as_id = lambda c: F.when(F.col(c) != "None", F.col(c)).cast(id_type)
    return got.select(as_id("page").alias("page_id"), "url", "record_type", as_id("refers").alias("refers_to"), "payload_digest", "stored_bytes", "sound", "file", "offset", "length")


def captures(records: DataFrame) -> DataFrame:
    """A row per record as read back: page_id, payload_bytes, payload_digest, record_type, refers_to, place in the archives.

    A revisit's length is that of the response it refers to, which has its digest too.
    """
    lengths = records.filter("record_type = 'response'").groupBy(F.col("page_id").alias("_of"), F.col("payload_digest").alias("_digest")).agg(F.max("stored_bytes").alias("_n"))
    again = records.filter("record_type = 'revisit'")
    again = again.join(lengths, (again["refers_to"] == lengths["_of"]) & (again["payload_digest"] == lengths["_digest"]), "left").withColumn("stored_bytes", F.col("_n")).drop("_of", "_digest", "_n")
    return records.filter("record_type = 'response'").unionByName(again).withColumnRenamed("stored_bytes", "payload_bytes")


def archived(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes the archives and their index (``path``-index), reads every url's captures through it, and returns ``captures``.

    A null html is an empty payload, a null url has an empty key, null ids are
    kept; rows of one id are told apart by their payloads, and each repeated row
    has a record; ties between equal payloads go to the smallest id.  Pages of
    any length are one record.  An empty table gives no rows, other columns are
    not read.
    """
    spark = pages.sparkSession
    path = path or f"{scratch_dir(spark)}/linkgrain/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, id_col=id_col, url_col=url_col, html_col=html_col, min_bytes=min_bytes)
    id_type = pages.schema[id_col].dataType
    index = write_index(written(read_warc(spark, path, id_type), "captures"), f"{path}-index")
    return captures(written(through_index(pages.select(F.col(url_col).alias("url")), index, path, id_type), "captures-read"))


@F.pandas_udf(T.StringType())
def surt_key(urls: pd.Series) -> pd.Series:
    return pd.Series([surt(x) for x in urls])


def write_index(records: DataFrame, path: str, block_captures: int = BLOCK_CAPTURES) -> str:
    """The two levels: ``path``/blocks, compressed runs of sorted captures, and ``path``/directory, a row for each block.

    Keys are sorted over the whole table by range, so files and blocks do not
    overlap but for equal keys, which sort on by page_id, file and offset.
    """
    lines = records.select(surt_key("url").alias("key"), F.col("page_id").cast("string").alias("page_id"), "record_type", "payload_digest", "file", "offset", "length")
    lines = lines.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True)
            while len(held) >= block_captures:
                yield block(held[:block_captures])
                held = held[block_captures:]
        if held:
            yield block(held)

    def block(rows):
        text = "\n".join("\t".join("" if x is None else str(x) for x in r) for r in rows)
        return pa.RecordBatch.from_arrays([pa.array([rows[0][0]]), pa.array([rows[-1][0]]), pa.array([len(rows)], pa.int64()), pa.array([zlib.compress(text.encode(), 6)], pa.binary())], ["first_key", "last_key", "n", "block"])

    lines.mapInArrow(run, "first_key string, last_key string, n bigint, block binary").write.option("parquet.block.size", 1 << 20).parquet(f"{path}/blocks")
    blocks = records.sparkSession.read.parquet(f"{path}/blocks")
    blocks.select("first_key", "last_key", "n", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).repartitionByRange("first_key", "file", "row").sortWithinPartitions("first_key", "file", "row").write.parquet(f"{path}/directory")
    return path


def lookup(spark, path: str, url: str) -> list[dict]:
    """Captures of one url: the directory names the blocks that can hold its key, each block is binary-searched."""
    key = surt(url)
    spans = spark.read.parquet(f"{path}/directory").filter((F.col("first_key") <= key) & (F.col("last_key") >= key)).select("file", "row")
    out = []
    for span in spans.toLocalIterator():  # as many as the key's captures fill
        data = spark.read.parquet(span["file"]).filter((F.col("_metadata.row_index") == span["row"]) & (F.col("first_key") <= key) & (F.col("last_key") >= key)).select("block").first()
        rows = [x.split("\t") for x in zlib.decompress(data["block"]).decode().split("\n")]
        keys = [r[0] for r in rows]
        for r in rows[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
            out.append(dict(zip(("key", "page_id", "record_type", "payload_digest", "file"), r, strict=False)) | {"offset": int(r[5]), "length": int(r[6])})
    return out


def places(urls: DataFrame, index: str) -> DataFrame:
    """(file, offset, length) of all captures of the keys of ``urls``.

    Every task knows the first and last key of the index's files, one row a
    file.  A file's keys meet its part of the directory, whose search names the
    blocks of a key; a search in each block names its captures.
    """
    spark = urls.sparkSession
    directory = spark.read.parquet(f"{index}/directory")
    files = directory.groupBy("file").agg(F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"))
    files = sorted(tuple(r) for r in files.select("first_key", "last_key", "file").toLocalIterator())
    held = spark.sparkContext.broadcast(tuple([r[k] for r in files] for k in range(3)))

    def named(batches):
        firsts, lasts, names = held.value
        for batch in batches:
            found = set()
            for key in {surt(None if url is None else _clean(url)) for url in batch.column(0).to_pylist()}:
                # Files, as blocks, overlap in equal keys alone, so both lists are sorted.
                found.update((names[k], key) for k in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], ["file", "key"])

    def blocks_of(keys: pa.Table, spans: pa.Table) -> pa.Table:
        spans = sorted(zip(*(spans[k].to_pylist() for k in ("first_key", "last_key", "row")), strict=True))
        firsts, lasts = [x[0] for x in spans], [x[1] for x in spans]
        found: dict[int, list[str]] = {}
        for key in set(keys["key"].to_pylist()):
            for k in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                found.setdefault(spans[k][2], []).append(key)
        return pa.table({"file": pa.array([keys["file"][0].as_py() for _ in found], pa.string()), "row": pa.array(list(found), pa.int64()), "keys": pa.array(list(found.values()), pa.list_(pa.string()))})

    def met(keys: pa.Table, spans: pa.Table) -> pa.Table:
        return blocks_of(keys, spans) if keys.num_rows else pa.table({"file": pa.array([], pa.string()), "row": pa.array([], pa.int64()), "keys": pa.array([], pa.list_(pa.string()))})

    def searched(batches):
        for batch in batches:
            out = []
            for data, wanted in zip(batch.column(0), batch.column(1), strict=True):
                rows = [x.split("\t") for x in zlib.decompress(data.as_py()).decode().split("\n")]
                keys = [r[0] for r in rows]
                for key in wanted.as_py():
                    out += [(r[4], int(r[5]), int(r[6])) for r in rows[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]]
            out.sort()
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["file", "offset", "length"])

    asked = urls.select("url").mapInArrow(named, "file string, key string").distinct()
    # At most BLOCK_CAPTURES keys a block.
    wanted = asked.groupBy("file").cogroup(directory.groupBy("file")).applyInArrow(met, "file string, row bigint, keys array<string>")
    blocks = spark.read.parquet(f"{index}/blocks").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "block")
    return blocks.join(wanted, ["file", "row"]).select("block", "keys").mapInArrow(searched, "file string, offset bigint, length bigint")


def _open(file: str):
    if file.startswith("file:"):
        return open("/" + file[5:].lstrip("/"), "rb")  # noqa: SIM115
    store, path = fs.FileSystem.from_uri(file)
    return store.open_input_file(path)


def _ranged(file: str) -> bool:
    """Whether tasks can open the store of ``file`` themselves."""
    try:
        _open(file).close()
    except (OSError, ValueError):
        return False
    return True


def through_index(urls: DataFrame, index: str, path: str, id_type: T.DataType) -> DataFrame:
    """A row as of ``read_warc`` per capture of ``urls``, each by one range read at the place in the index.

    In a store that only Spark opens the ranges are cut from files it reads.
    """
    spark = urls.sparkSession

    def ranges(batches):
        for batch in batches:
            out, name, stream = [], None, None
            for file, at, n in sorted(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                if file != name:
                    if stream:
                        stream.close()
                    name, stream = file, _open(file)
                stream.seek(at)
                _, _, headers, payload = next(read_records(stream.read(n)))
                out.append(_row(file, at, n, headers, payload))
            if stream:
                stream.close()
            yield _batch(out)

    def cut(wanted: pa.Table, files: pa.Table) -> pa.Table:
        out = []
        for file, at, n in zip(*(wanted[k].to_pylist() for k in ("file", "offset", "length")), strict=True):
            _, _, headers, payload = next(read_records(memoryview(files["content"][0].as_buffer())[at : at + n].tobytes()))
            out.append(_row(file, at, n, headers, payload))
        return pa.Table.from_batches([_batch(out)])

    found = places(urls, index)
    one = _archives(spark, path).select("path").first()
    if one is None or _ranged(one["path"]):
        return _named(found.mapInArrow(ranges, RECORD), id_type)
    return _named(found.groupBy("file").cogroup(_archives(spark, path).groupBy("path")).applyInArrow(cut, RECORD), id_type)


def read_range(spark, file: str, offset: int, length: int) -> tuple[dict, bytes]:
    """Headers and payload of the record at a place, by one range read through Spark's file system layer."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        stream.seek(offset)
        data = bytes(stream.readNBytes(length))
    finally:
        stream.close()
    _, _, headers, payload = next(read_records(data))
    return headers, payload

