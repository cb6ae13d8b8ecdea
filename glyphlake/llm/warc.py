"""Web archives without repeated payloads: records whose payload an earlier record has become revisits of it.

Archives are WARC/1.1 files, a gzip member for each record. Spark's own text sink writes them, so its commit protocol holds and a lost executor leaves
no half archive: a task hands on volumes of VOLUME bytes, one to a file, and each ends with an empty member, whose last byte, zero, is what the sink
puts after a row. The files are named part-*.txt, as the sink has it. A volume is read by one task, member by member, so its size bounds a
reader's memory; a single record may be longer.

Resolution: headers, without payloads, are shuffled by digest and length of their payload. Of each group the record with the smallest key, ties by
record id, is the original; counts and minima are combined before the shuffle, and groups that hold much of the table are joined where their
rows are. Decisions go to the records by record id, with payloads as they lie compressed in the archive, and new archives are written
with fresh headers. Revisit records have no payload; `with_originals` joins them to the records they refer to.

Nulls and edge cases: a null payload is the empty one, a null url the empty one; a null key is larger than any other and is no number in the archive;
repeated rows are records each, one of which is the original; an empty table gives an archive without records; line ends
in urls are taken out of headers; payloads may hold anything, headers of records included; any other columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm.components import join_skewed
from glyphlake.llm.words import saved, shared_folder

#: Compressed bytes of a volume, and bytes of payload that a reader hands on at once.
VOLUME, TURN = 32 << 20, 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What an archive's record is read into.
RECORD = "record_id string, record_type string, key long, url string, date string, payload_digest string, payload_bytes long, refers_to_id string, refers_to_key long, member binary"
#: An empty gzip member: header, no data, checksum and length of nothing.
END = bytes.fromhex("1f8b08000000000000ff03000000000000000000")


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(record: dict, payload: bytes) -> bytes:
    """A record as a gzip member. A revisit's block is the HTTP header alone."""
    is_revisit = record["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if is_revisit:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if is_revisit else http + payload
    fields = [("WARC-Type", record["record_type"]), ("WARC-Record-ID", f"<{record['record_id']}>"), ("WARC-Date", record["date"]), ("WARC-Target-URI", record["url"]), ("WARC-Payload-Digest", f"sha1:{record['payload_digest']}"), ("WARC-Block-Digest", f"sha1:{_digest(block)}")]
    if is_revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record['refers_to_id']}>"), ("WARC-Refers-To-Target-URI", record["refers_to_url"]), ("WARC-Refers-To-Date", record["refers_to_date"]), ("X-Refers-To-Key", record["refers_to_key"])]
    fields += [("X-Key", record["key"]), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    head = "".join(f"{name}: {' '.join(str(value).split()) if name.endswith('URI') else value}\r\n" for name, value in fields if value is not None)
    packer = zlib.compressobj(6, wbits=31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def _volumes(members: Iterator[bytes], size: int) -> Iterator[pa.RecordBatch]:
    """Members joined to volumes, without the last byte of the empty member at their end."""
    held, n = [], 0
    for m in members:
        held.append(m)
        n += len(m)
        if n >= size:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join([*held, END[:-1]])], pa.binary())], names=["value"])
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join([*held, END[:-1]])], pa.binary())], names=["value"])


def _write(volumes: DataFrame, folder: str) -> None:
    volumes.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(folder)


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str | None = None, volume: int = VOLUME) -> None:
    """A response record for each row, payload in UTF-8 where it is a string."""
    now = date or f"{datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}"
    rows = pages.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def members() -> Iterator[bytes]:
            n = 0
            for b in batches:
                for k, u, p in zip(*(b.column(c) for c in ("key", "url", "payload")), strict=True):
                    body = p.as_py()
                    digest = _digest(body)
                    # Reproducible, so that a task that runs again writes the same archive; place and time make it unique.
                    name = uuid.UUID(bytes=hashlib.md5(f"{now} {folder} {part} {n} {k} {digest}".encode()).digest(), version=4).urn
                    n += 1
                    yield _member({"record_type": "response", "record_id": name, "date": now, "url": u.as_py(), "payload_digest": digest, "key": k.as_py()}, body)

        yield from _volumes(members(), volume)

    _write(rows.mapInArrow(run, "value binary"), folder)


def _unpacked(data: memoryview) -> Iterator[tuple[memoryview, bytes]]:
    """Each gzip member and what it holds, empty ones left out. Input goes in by small steps, so that little is copied twice."""
    at = 0
    while at < len(data):
        reader, out, start = zlib.decompressobj(wbits=31), [], at
        while not reader.eof:
            if at >= len(data):
                raise ValueError("an archive ends within a record")
            step = data[at : at + (1 << 15)]
            out.append(reader.decompress(step))
            at += len(step)
        at -= len(reader.unused_data)
        content = b"".join(out)
        if content:
            yield data[start:at], content


def _parsed(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields in lower case, block, and payload, which is what follows the HTTP header."""
    end = content.index(b"\r\n\r\n")
    first, *lines = content[:end].decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError(f"no record: {first[:40]!r}")
    fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    block = content[end + 4 : end + 4 + int(fields["content-length"])]
    if content[end + 4 + len(block) :] != b"\r\n\r\n":
        raise ValueError(f"{fields.get('warc-record-id')}: its block is not as long as it says")
    return fields, block, block[block.index(b"\r\n\r\n") + 4 :] if block.startswith(b"HTTP/") else block


def read_archives(spark: SparkSession, folder: str, members: bool = False) -> DataFrame:
    """The records (RECORD) of all archives of a folder; digests of payloads are verified. `member` is the compressed record where asked for.

    payload_bytes is null for revisit records.
    """
    names = [f.split(" ")[0] for f in RECORD.split(", ")]
    schema = pa.schema(list(zip(names, [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for data in b.column(0):
                for member, content in _unpacked(memoryview(data.as_buffer())):
                    f, _, payload = _parsed(content)
                    digest = f["warc-payload-digest"].removeprefix("sha1:")
                    is_revisit = f["warc-type"] == "revisit"
                    if not is_revisit and _digest(payload) != digest:
                        raise ValueError(f"{f['warc-record-id']}: its payload has another digest")
                    number = lambda name, f=f: int(f[name]) if name in f else None
                    refers = f["warc-refers-to"].strip("<>") if is_revisit else None
                    rows.append((f["warc-record-id"].strip("<>"), f["warc-type"], number("x-key"), f["warc-target-uri"], f["warc-date"], digest, None if is_revisit else len(payload), refers, number("x-refers-to-key"), bytes(member) if members else None))
                    size += len(member) if members else 200
                    if size >= TURN:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(run, RECORD)


def resolve(records: DataFrame, least: int = 0) -> DataFrame:
    """(record_id, refers_to): for each record whose payload of at least `least` bytes another has, too, and which is not the first of them, that first one."""
    heads = records.filter("record_type = 'response'").select("record_id", "key", "url", "date", "payload_digest", "payload_bytes").filter(F.col("payload_bytes") >= least)
    first = F.min_by(F.struct("record_id", "key", "url", "date"), F.struct(F.col("key").isNull(), "key", "record_id"))
    groups = saved(heads.groupBy("payload_digest", "payload_bytes").agg(first.alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    found = join_skewed(heads.select("record_id", "payload_digest", "payload_bytes"), groups, ["payload_digest", "payload_bytes"], "n")
    return found.filter("refers_to is not null and record_id <> refers_to.record_id").select("record_id", "refers_to")


def write_deduplicated(records: DataFrame, resolution: DataFrame, folder: str, date: str | None = None, volume: int = VOLUME) -> None:
    """The records, with their members, as new archives with fresh headers; those that `resolution` names become revisits."""
    now = date or f"{datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}"
    rows = records.select("record_id", "member").join(resolution, "record_id", "left")
    rows = rows.select("member", F.col("refers_to.record_id").alias("refers_to_id"), F.col("refers_to.key").alias("refers_to_key"), F.col("refers_to.url").alias("refers_to_url"), F.col("refers_to.date").alias("refers_to_date"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members() -> Iterator[bytes]:
            for b in batches:
                for data, *other in zip(*b.columns, strict=True):
                    _, content = next(_unpacked(memoryview(data.as_buffer())))
                    f, _, payload = _parsed(content)
                    refers = dict(zip(("refers_to_id", "refers_to_key", "refers_to_url", "refers_to_date"), (x.as_py() for x in other), strict=True))
                    if f["warc-type"] == "revisit":  # it was one before and refers to the same record
                        refers = {"refers_to_id": f["warc-refers-to"].strip("<>"), "refers_to_key": f.get("x-refers-to-key"), "refers_to_url": f.get("warc-refers-to-target-uri"), "refers_to_date": f.get("warc-refers-to-date")}
                    kind = "revisit" if refers["refers_to_id"] else f["warc-type"]
                    yield _member({"record_type": kind, "record_id": f["warc-record-id"].strip("<>"), "date": now if kind == "revisit" else f["warc-date"], "url": f["warc-target-uri"], "payload_digest": f["warc-payload-digest"].removeprefix("sha1:"), "key": f.get("x-key"), **refers}, payload)

        yield from _volumes(members(), volume)

    _write(rows.mapInArrow(run, "value binary"), folder)


def with_originals(records: DataFrame) -> DataFrame:
    """The records, where a revisit has the payload_bytes of the record it refers to; they are null if that is not there."""
    revisits = records.filter("record_type = 'revisit'").drop("payload_bytes")
    wanted = revisits.groupBy(F.col("refers_to_id").alias("record_id")).agg(F.count(F.lit(1)).alias("n"))
    originals = saved(wanted.join(records.filter("record_type <> 'revisit'").select("record_id", "payload_bytes"), "record_id").select(F.col("record_id").alias("refers_to_id"), "payload_bytes", "n"))
    found = join_skewed(revisits, originals, ["refers_to_id"], "n")
    return records.filter("record_type <> 'revisit'").unionByName(found.select(*records.columns))


def deduplicated(pages: DataFrame, folder: str, least: int = 0, volume: int = VOLUME) -> DataFrame:
    """Archives of the pages at folder/pages, the same without repeated payloads at folder/deduplicated, and what the latter hold."""
    spark = pages.sparkSession
    write_archives(pages, f"{folder}/pages", volume=volume)
    write_deduplicated(read_archives(spark, f"{folder}/pages", members=True), resolve(read_archives(spark, f"{folder}/pages"), least), f"{folder}/deduplicated", volume=volume)
    return with_originals(saved(read_archives(spark, f"{folder}/deduplicated").drop("member")))


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def op12_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    records = deduplicated(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    remove(spark, folder)  # the records are in a table of their own; other callers of `deduplicated` keep the archives
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").alias("refers_to"))
