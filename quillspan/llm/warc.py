"""WARC archives: a Spark sink for records and a PySpark data source that reads them back.

Writing is Spark's own text sink, one record a row, so archives go to any file
system that Spark writes to, with its committer.  Reading is a Python data
source named ``warc``: it plans partitions of whole files by size, takes
predicates on header fields, parses a record's headers first, and seeks past
the block of every record that the predicates or the ``payload`` option do not
want.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringContains, StringStartsWith

#: Fixed values of the format: record separator, base32 alphabet, revisit profile.
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Bytes of archive files that one partition reads, in whole files.
PARTITION_BYTES = 64 << 20
RECORDS_A_FILE = 50_000

SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, payload_bytes long, block_bytes long, payload binary, path string"
_FIELDS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's bytes, in Spark functions: 5 hex digits make 4 characters."""
    digest = F.sha1(data)
    out = []
    for i in range(0, 40, 5):
        bits = F.conv(F.substring(digest, i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _clean(uri: Column) -> Column:
    """A header value: control characters would end the line, so they are percent-encoded or dropped."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(uri, "\r", "%0D"), "\n", "%0A"), "[\\x00-\\x1f\\x7f]", "")


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One row a page: page_id, record_type and the WARC record as a string.

    Of pages with equal payloads of at least ``min_bytes`` bytes, those of the
    largest page_id are responses and others revisits of it.  A null html is
    an empty payload; a null page_id loses to any other, and if no page of the
    payload has an id, all are responses; a null url is the record's own id.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    base = base.withColumn("digest", sha1_base32(F.col("payload"))).withColumn("size", F.octet_length("payload"))
    first = base.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("holder"), F.count("*").alias("k"))
    first = first.where("k > 1").drop("k")
    joined = base.join(first, ["digest", "size"], "left")
    revisit = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    own = F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    refers = F.concat(F.lit("WARC-Refers-To: <urn:x-page:"), F.col("holder").cast("string"), F.lit(f">\r\nWARC-Profile: {PROFILE}\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        own,
        F.lit("\r\nWARC-Target-URI: "),
        F.coalesce(_clean(F.col("url")), F.substring_index(F.substring_index(own, "<", -1), ">", 1)),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\n"),
        F.when(revisit, refers).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
        block,
    )
    return joined.select("page_id", F.when(revisit, "revisit").otherwise("response").alias("record_type"), header.alias("record"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, compression: str = "none") -> None:
    """Writes the pages as archive files in the folder ``path``; ``compression`` may be gzip."""
    out = records(pages, min_bytes).select("record").write
    out.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records under ``path``; Spark lists the files, so that any of its file systems can be planned."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0").collect()
    listing = "\n".join(f"{r.length} {r.path}" for r in sorted(files, key=lambda r: r.path))
    return spark.read.format("warc").option("files", listing).option("payload", str(payload).lower()).load()


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcDataSource(DataSource):
    """Options: ``files``, lines of size and address; ``payload``, false to skip every block."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.files = [(int(n), p) for n, p in (line.split(" ", 1) for line in options.get("files", "").splitlines())]
        self.payload = options.get("payload", "true") == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            kind = {EqualTo: "eq", In: "in", StringStartsWith: "starts", StringContains: "contains", IsNotNull: "set"}.get(type(f))
            if name in _FIELDS and kind:
                self.tests.append((_FIELDS[name], kind, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Whole files, together up to PARTITION_BYTES, so that no record is cut."""
        out: list[list[str]] = []
        room = 0
        for n, path in self.files:
            if not out or room < n:
                out.append([])
                room = PARTITION_BYTES
            out[-1].append(path)
            room -= n
        return [_Files(paths) for paths in out]

    def _wanted(self, head: dict[str, str]) -> bool:
        for field, kind, value in self.tests:
            have = head.get(field)
            ok = have is not None and (
                kind == "set" or kind == "eq" and have == value or kind == "in" and have in value or kind == "starts" and have.startswith(value) or kind == "contains" and value in have
            )
            if not ok:
                return False
        return True

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.binary(), pa.string()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        rows, held = [], 0
        for path in partition.paths:
            with open_archive(path) as file:
                for head, block in scan(file, self._wanted, self.payload):
                    rows.append((*[head.get(f) for f in _FIELDS.values()], *block, path))
                    held += len(block[2] or b"") + 500
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def open_archive(path: str):
    """A binary stream of a local or remote file, decompressed if its name ends in .gz."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        raw = open(unquote(parts.path), "rb")
    else:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        raw = io.BufferedReader(system.open_input_file(inner))
    return gzip.open(raw, "rb") if path.endswith(".gz") else raw


def _headers(file) -> tuple[str, dict[str, str]]:
    """A first line and the header fields up to a blank line, names in lower case; folded lines are joined."""
    first = file.readline().decode("utf-8", "replace").strip()
    fields: dict[str, str] = {}
    last = None
    while (line := file.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and last:
            fields[last] += " " + text.strip()
            continue
        key, _, value = text.partition(":")
        last = key.strip().lower()
        fields[last] = value.strip()
    return first, fields


def scan(file, wanted=lambda head: True, payload: bool = True) -> Iterator[tuple[dict[str, str], tuple]]:
    """Each wanted record's headers and (payload bytes, block bytes, payload); other blocks are passed over unread."""
    while True:
        line = file.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record's start: {line[:40]!r}")
        _, head = _headers(_Again(line, file))
        size = int(head["content-length"])
        if not wanted(head):
            file.seek(size, 1)
            continue
        end = file.tell() + size
        http = head.get("content-type", "").startswith("application/http")
        length, body = size, None
        if http and size:
            _, fields = _headers(file)
            length = int(fields.get("content-length", end - file.tell()))
        if payload and head.get("warc-type") != "revisit":
            body = file.read(end - file.tell())
            length = len(body)
        file.seek(end)
        yield head, (length, size, body)


class _Again:
    """A stream that first gives back a line already read."""

    def __init__(self, line: bytes, file):
        self.line, self.file = line, file

    def readline(self) -> bytes:
        line, self.line = self.line, None
        return line if line is not None else self.file.readline()


def page_records(found: DataFrame) -> DataFrame:
    """Archive records as page_id, payload_bytes, payload_digest, record_type, refers_to, with digests checked against payloads."""

    def page(uri: str) -> Column:
        return F.nullif(F.regexp_extract(uri, "^<urn:x-page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")

    stated = F.regexp_replace("payload_digest", "^sha1:", "")
    actual = F.when(F.col("record_type") == "response", sha1_base32(F.col("payload"))).otherwise(stated)
    return found.select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        F.when(actual == stated, actual).otherwise(F.raise_error(F.lit("a payload differs from its digest"))).cast("string").alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )
