"""WARC archives (operator 3): a PySpark data source that writes and reads them.

Writing: every record is a gzip member of its own, as is usual for WARC files. The member's header
carries the lengths of its compressed and plain bytes ("sl" extra field), so a reader can pass
over a record without inflating it. Each attempt of a task writes a file of its own name;
committing lists the files that count in ``_committed.json``, so files of lost or repeated attempts
are never read. Which records are revisits is decided on narrow rows (digest, largest id), not on payloads.

Reading: ``spark.read.format("warc")`` plans one partition for each group of whole
files of about ``split_mb``, cut at ``split_mb`` for larger files; a partition reads the records that
start within its range. Equality and IN predicates on ``record_type``, ``record_id``,
``target_uri`` and ``content_type`` are pushed down and judged on the header, which is inflated first; a payload
that they reject is neither read nor inflated nor decoded. With the option
``payload`` set to ``digest`` or ``none`` wanted payloads are hashed or skipped but never decoded. Plain (not
compressed) files and gzip members without the lengths are read as well.

Defined results of the round trip: null html is an empty payload; a null page_id is kept
as such and is never referred to; pages of equal payload and id repeat the same record;
an empty table gives an empty archive and result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceArrowWriter, EqualTo, In, InputPartition, WriterCommitMessage)

from .common import broadcast_if_small, new_path, read, staged

MIN_REVISIT = 1000
MAX_BROADCAST_COPIES = 500_000
LEVEL = 1  # of zlib
CRLF, MAGIC, GZIP, COMMITTED = "\r\n", b"WARC/1.0\r\n", b"\x1f\x8b\x08", "_committed.json"
SCHEMA = ("record_type string, record_id string, target_uri string, content_type string, refers_to string, headers map<string,string>, "
          "payload_bytes long, payload_digest string, payload string")
PUSHED = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "content_type": "content-type"}


class FileRange(InputPartition):
    """Byte ranges of files: [(path, start, end)]."""

    def __init__(self, ranges):
        self.ranges = ranges


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


def _open(path: str):
    """(file system, path in it) of a local path or a URI; Spark's names of object stores are put as pyarrow has them."""
    for spark_name, name in (("s3a://", "s3://"), ("s3n://", "s3://"), ("wasbs://", "abfss://")):
        if path.startswith(spark_name):
            path = name + path[len(spark_name):]
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (
        pyarrow.fs.LocalFileSystem(), path)


# writing


def member(record: bytes) -> bytes:
    """A gzip member that tells its own lengths."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    total = 10 + 2 + 12 + len(body) + 8
    return (GZIP + b"\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
            + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF))


class WarcWriter(DataSourceArrowWriter):
    """Rows (head string, payload string)."""

    def __init__(self, options, overwrite):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, batches):
        fs, at = _open(self.path)
        fs.create_dir(at, recursive=True)
        name, out = f"part-{uuid.uuid4().hex}.warc.gz", None
        for b in batches:
            for head, payload in zip(b.column(0), b.column(1)):
                out = out or fs.open_output_stream(f"{at}/{name}", compression=None)
                out.write(member(b"".join((head.as_py().encode(), b"\r\n\r\n", (payload.as_py() or "").encode("utf-8", "surrogatepass"), b"\r\n\r\n"))))
        if out:
            out.close()
        return Written([name] if out else [])

    def commit(self, messages):
        fs, at = _open(self.path)
        fs.create_dir(at, recursive=True)
        names = [n for m in messages if m for n in m.names]
        if not self.overwrite and fs.get_file_info(f"{at}/{COMMITTED}").is_file:
            names += _committed(fs, at)
        with fs.open_output_stream(f"{at}/{COMMITTED}", compression=None) as f:
            f.write(json.dumps(sorted(names)).encode())

    def abort(self, messages):
        fs, at = _open(self.path)
        for name in [n for m in messages if m for n in m.names]:
            fs.delete_file(f"{at}/{name}")


def _committed(fs, at: str) -> list[str]:
    with fs.open_input_stream(f"{at}/{COMMITTED}", compression=None) as f:
        return json.loads(f.read())


# reading


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split = int(float(options.get("split_mb", 32)) * (1 << 20))
        self.payload = options.get("payload", "text")
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = ".".join(f.attribute) if isinstance(f, (EqualTo, In)) else None
            if name in PUSHED:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def partitions(self):
        fs, at = _open(self.path)
        infos = fs.get_file_info(pyarrow.fs.FileSelector(at)) if fs.get_file_info(at).type == pyarrow.fs.FileType.Directory \
            else [fs.get_file_info(at)]
        if any(i.base_name == COMMITTED for i in infos):
            names = set(_committed(fs, at))
            infos = [i for i in infos if i.base_name in names]
        files = sorted((i.path, i.size) for i in infos if i.is_file and i.size and not i.base_name.startswith(("_", ".")))
        out, held, size = [], [], 0
        for path, n in files:
            for start in range(0, n, self.split):
                end = min(n, start + self.split)
                if held and size + end - start > self.split:
                    out.append(FileRange(held))
                    held, size = [], 0
                held.append((path, start, end))
                size += end - start
        return [*out, FileRange(held)] if held else out or [FileRange([])]

    def read(self, partition):
        fs, _ = _open(self.path)
        for path, start, end in partition.ranges:
            with fs.open_input_file(path) as f:
                f.seek(0)
                yield from (self.members if f.read(3) == GZIP else self.records)(f, start, end)

    def members(self, f, start: int, end: int):
        """Records of a file of gzip members."""
        at = first_member(f, start)
        while at is not None and at < end:
            m = Member(f, at)
            head = m.header()
            if head is None:
                return
            fields, n = head, int(head.get("content-length", 0))
            if self.wants(fields):
                yield self.row(fields, n, lambda: m.payload(n))
            at = m.next()

    def records(self, f, start: int, end: int):
        """Records of a plain file."""
        at = first_record(f, start)
        while at is not None and at < end:
            head = header_at(f, at)
            if head is None:
                return
            fields, body = head
            n = int(fields.get("content-length", 0))

            def payload():
                f.seek(body)
                return f.read(n)

            if self.wants(fields):
                yield self.row(fields, n, payload)
            at = body + n + 4

    def wants(self, fields) -> bool:
        return all(fields.get(PUSHED[name]) in values for name, values in self.wanted.items())

    def row(self, fields, n: int, payload):
        size, digest, text = n, fields.get("warc-payload-digest"), None
        digest = base64.b32decode(digest[5:]).hex() if digest and digest.startswith("sha1:") else digest
        if fields.get("warc-type") == "revisit":
            size = int(fields.get("x-payload-length", 0))
        elif self.payload != "none":
            raw = payload()
            digest = hashlib.sha1(raw).hexdigest()
            text = raw.decode("utf-8", "replace") if self.payload == "text" else None
        return (*[fields.get(x) for x in PUSHED.values()], fields.get("warc-refers-to"), fields, size, digest, text)


class Member:
    """A gzip member, inflated as far as it is asked for."""

    def __init__(self, f, at: int):
        self.f, self.at, self.got = f, at, b""
        f.seek(at)
        raw = f.read(24)
        known = raw[3:4] == b"\x04" and raw[12:16] == b"sl\x08\0"
        self.length = struct.unpack("<I", raw[16:20])[0] if known else None
        self.inflater, self.read_to = zlib.decompressobj(31), at

    def more(self, n: int) -> bool:
        self.f.seek(self.read_to)
        raw = self.f.read(n)
        self.read_to += len(raw)
        self.got += self.inflater.decompress(raw)
        return bool(raw) and not self.inflater.eof

    def header(self):
        while (stop := self.got.find(b"\r\n\r\n")) < 0:
            if not self.more(1024) and b"\r\n\r\n" not in self.got:
                return None
        self.body = stop + 4
        return _fields(self.got[:stop])

    def payload(self, n: int) -> bytes:
        parts, size = [self.got[self.body:]], len(self.got) - self.body
        while size < n and not self.inflater.eof:
            self.f.seek(self.read_to)
            raw = self.f.read(1 << 16 if self.length is None else max(1, min(1 << 20, self.at + self.length - self.read_to)))
            if not raw:
                break
            self.read_to += len(raw)
            parts.append(self.inflater.decompress(raw))
            size += len(parts[-1])
        return b"".join(parts)[:n]

    def next(self) -> int:
        """Where the next member begins; without a known length the rest has to be inflated."""
        if self.length is not None:
            return self.at + self.length
        while not self.inflater.eof:
            self.got = b""
            if not self.more(1 << 16) and not self.inflater.eof:
                break
        return self.read_to - len(self.inflater.unused_data)


def _fields(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split(CRLF)
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def header_at(f, at: int):
    """(fields, offset of the payload) of the plain record at ``at``; None at the file's end."""
    got = b""
    while (stop := got.find(b"\r\n\r\n")) < 0:
        f.seek(at + len(got))
        more = f.read(4096)
        if not more:
            return None
        got += more
    return _fields(got[:stop]), at + stop + 4


def _found(f, start: int, mark: bytes, is_one):
    """First place at or after ``start`` with the mark for which is_one(place) holds."""
    size, got, base = f.size(), b"", start
    while base + len(got) < size:
        f.seek(base + len(got))
        got += f.read(1 << 16)
        here = 0
        while (p := got.find(mark, here)) >= 0:
            if is_one(base + p):
                return base + p
            here = p + 1
        keep = len(mark) - 1
        base, got = base + max(0, len(got) - keep), got[-keep:]
    return None


def first_member(f, start: int):
    """Offset of the first gzip member at or after ``start``: one that inflates to the head of a record."""

    def is_one(at):
        try:
            f.seek(at)
            return zlib.decompressobj(31).decompress(f.read(512)).startswith(MAGIC)
        except zlib.error:
            return False

    return 0 if start == 0 else _found(f, start, GZIP, is_one)


def first_record(f, start: int):
    """Offset of the first plain record at or after ``start``. In the midst of a file that is the
    first place after a record's end that reads like a record's head and from which
    the next record follows where the length says."""
    if start == 0:
        return 0
    at = _found(f, max(0, start - 4), b"\r\n\r\n" + MAGIC, lambda p: _is_record(f, p + 4, f.size()))
    return None if at is None else at + 4


def _is_record(f, at: int, size: int) -> bool:
    head = header_at(f, at)
    if head is None or "warc-record-id" not in head[0] or not head[0].get("content-length", "").isdigit():
        return False
    stop = head[1] + int(head[0]["content-length"])
    f.seek(stop)
    return f.read(4) == b"\r\n\r\n" and (stop + 4 == size or f.read(len(MAGIC)) == MAGIC)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**options).load(path)


def _clean(c: Column) -> Column:
    """A header's value: no line ends in it."""
    return F.regexp_replace(c, r"[\r\n]+", " ")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               min_revisit: int = MIN_REVISIT) -> None:
    """A response record for each page, or a revisit record where a page of larger id has
    the same payload of at least ``min_revisit`` bytes."""
    spark = pages.sparkSession
    html = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    n = F.octet_length(html).cast("long")
    known = pages.where(n >= min_revisit).select(F.col(id_col).alias("id"), F.unhex(F.sha1(html)).alias("d")).groupBy("d").agg(
        F.max("id").alias("master"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("d", "master")
    # digests that several pages have; where they are many, the skewed join of adaptive execution splits common ones
    known = broadcast_if_small(staged(known, "warc-copies"), MAX_BROADCAST_COPIES)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"),
                        n.alias("n"), F.sha1(html).alias("digest")).withColumn("d", F.unhex("digest"))
    rows = rows.join(known, "d", "left")
    revisit = F.col("master").isNotNull() & ~F.col("id").eqNullSafe(F.col("master")) & (F.col("n") >= min_revisit)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    header = F.concat_ws(
        CRLF, F.lit("WARC/1.0"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("id"))), F.concat(F.lit("WARC-Target-URI: "), _clean(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("digest"))), F.lit("Content-Type: text/html; charset=utf-8"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("master")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("X-Payload-Length: "), F.col("n").cast("string"))),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))))
    small = rows.select(header.alias("head"), F.when(~revisit, F.col("html")).alias("payload"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.dataSource.register(WarcSource)
    small.write.format("warc").mode("append").save(path)


def base32(hexes: Column) -> Column:
    """RFC 4648 base 32 of 40 hexadecimal digits: eight groups of five digits, four letters each."""
    out = [F.lpad(F.conv(F.substring(hexes, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*out), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def op3_warc(spark, sf_dir) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(read(spark, sf_dir, "pages"), path)
    out = read_warc(spark, path, payload="digest").where(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.regexp_extract(c, r"urn:page:(-?\d+)", 1).try_cast("bigint")
    return out.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                      page(F.col("refers_to")).alias("refers_to"))


QUERIES = {"op3_warc": op3_warc}

ORACLE_SQL = {"op3_warc": f"""
with p as (select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes,
             sha1(coalesce(html, '')) as payload_digest from pages),
m as (select payload_digest, max(page_id) as m from p where payload_bytes >= {MIN_REVISIT} group by payload_digest)
select page_id, payload_bytes, payload_digest,
  case when m is not null and m <> page_id then 'revisit' else 'response' end as record_type,
  case when m <> page_id then m end as refers_to
from p left join m using (payload_digest)"""}
