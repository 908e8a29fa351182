"""WARC archives with revisit resolution.

Headers (identifier, payload digest, length) are shuffled by digest, never payloads: the largest identifier of each
repeated digest keeps its payload, the other records become revisits that refer to it, and archives are written with
fresh headers by Spark's own text writer, so any Hadoop file system takes them. Reading parses records by their
Content-Length and measures what is there; revisits are joined to the responses they refer to.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow, joined, pick, work_path, written

INDEX = "page_id long, record_type string, record_id string, refers_to_record string, target_uri string, payload_bytes long, payload_digest string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"


def resolve(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, html (null as empty), payload digest and length, and ``refers_to`` where the record is a revisit.

    Of records with equal payloads of at least ``least_bytes`` bytes that with the largest page_id keeps its payload
    and the others refer to it. A null page_id is neither. Rows that repeat the largest page_id all keep theirs.

    Headers alone are shuffled by digest. What comes back is one small row for each revisit, by page_id and digest; the
    payloads meet it in a join in which the rows that stay responses have a key of their own, so no page_id is hot.
    """
    base = pick(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    base = base.withColumns({"payload_digest": F.sha1(F.col("html").cast("binary")), "payload_bytes": F.octet_length("html").cast("long")})
    headers = base.where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "url", "payload_digest")
    # written: the join of headers has plain exchanges on both sides, which adaptive execution splits where a digest is hot
    kept = written(headers.groupBy("payload_digest").agg(F.max(F.struct("page_id", "url")).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_digest", "kept"), "originals")
    solved = headers.select("page_id", "payload_digest").join(kept, "payload_digest").where(F.col("page_id") < F.col("kept.page_id"))
    solved = written(solved.groupBy("page_id", "payload_digest").agg(F.first("kept").alias("kept")).select(F.col("page_id").alias("r_page"), F.col("payload_digest").alias("r_digest"), "kept"), "revisits")
    found = base.join(solved, (F.col("page_id") == F.col("r_page")) & (F.col("payload_digest") == F.col("r_digest")), "left")
    return found.select("page_id", "url", F.when(F.col("kept").isNull(), F.col("html")).alias("html"), "payload_digest", "payload_bytes", F.col("kept.page_id").alias("refers_to"), F.col("kept.url").alias("refers_to_url"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = 32 << 20, compression: str = "gzip") -> None:
    """Archives of all ``pages`` under ``path``, about ``archive_bytes`` of records each, revisits resolved.

    Null urls become ``urn:page:`` names; line breaks in urls are percent-encoded. An empty table writes no record.
    """
    records = resolve(pages, least_bytes)
    mean = pages.select(F.avg(F.octet_length("html"))).first()[0] or 0.0
    record_id = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    uri = lambda url, c: F.regexp_replace(F.regexp_replace(F.coalesce(url, F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))), "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(EOL))
    is_revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(EOL * 2))
    block = F.concat(http, F.when(is_revisit, F.lit("")).otherwise(F.col("html")))
    record = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        line("WARC-Type", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri(F.col("url"), F.col("page_id"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(is_revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("refers_to"))), line("WARC-Refers-To-Target-URI", uri(F.col("refers_to_url"), F.col("refers_to"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(EOL),
        block,
    )
    # the two line ends that close each record are the writer's separator
    writer = records.select(record.alias("value")).write.option("lineSep", EOL * 2).option("maxRecordsPerFile", max(1, int(archive_bytes / (mean + 500))))
    writer.option("compression", compression).text(path)


class Stream:
    """Reads lines and exact numbers of bytes from an archive, gzip members or plain, without unpacking it at once."""

    def __init__(self, content: bytes, step: int = 1 << 20):
        self.content, self.at, self.step, self.ready = memoryview(content), 0, step, bytearray()
        self.unpack = zlib.decompressobj(31) if bytes(content[:2]) == b"\x1f\x8b" else None

    def more(self) -> bool:
        if self.unpack is not None and self.unpack.eof:
            rest = self.unpack.unused_data
            self.at -= len(rest)
            self.unpack = zlib.decompressobj(31)
        part = self.content[self.at : self.at + self.step]
        if not len(part):
            return False
        self.at += len(part)
        self.ready += part if self.unpack is None else self.unpack.decompress(part)
        return True

    def line(self) -> bytes | None:
        start = 0
        while (end := self.ready.find(b"\r\n", start)) < 0:
            start = max(len(self.ready) - 1, 0)
            if not self.more():
                return None
        out = bytes(self.ready[:end])
        del self.ready[: end + 2]
        return out

    def take(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self.more():
                raise ValueError("an archive ends within a record")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out


def records(content: bytes):
    """(headers by lower-case name, block) of each record of an archive."""
    stream = Stream(content)
    while (first := stream.line()) is not None:
        if not first:
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError("a record does not begin with its version")
        headers = {}
        while h := stream.line():
            name, _, value = h.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode()
        yield headers, stream.take(int(headers["content-length"]))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row (INDEX) per record of the archives under ``path``; length and digest of responses are measured."""

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                rows = {c.split()[0]: [] for c in INDEX.split(", ")}
                for headers, block in records(content.as_py()):
                    response = headers["warc-type"] == "response"
                    head, gap, payload = block.partition(b"\r\n\r\n")
                    own = headers["warc-record-id"]
                    number = own.removeprefix("<urn:page:").removesuffix(">")
                    for name, value in zip(rows, (None if number == "none" else int(number), headers["warc-type"], own, headers.get("warc-refers-to"), headers.get("warc-target-uri"), len(payload) if response else None, hashlib.sha1(payload).hexdigest() if response else headers["warc-payload-digest"].removeprefix("sha1:"))):
                        rows[name].append(value)
                types = {"page_id": pa.int64(), "payload_bytes": pa.int64()}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, types.get(k, pa.string())) for k, v in rows.items()})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return arrow(files.select("content"), parse, INDEX)


def round_trip(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Write archives of ``pages``, read them back and resolve each record: page_id, payload_bytes, payload_digest,
    record_type and refers_to (the response's page_id for revisits).

    Null html is an empty payload; payloads below ``least_bytes`` bytes are never revisits; repeated rows give a record
    each; extra columns are ignored.
    """
    spark = pages.sparkSession
    path = work_path(spark, "archives")
    write_archives(pages, path, least_bytes)
    index = written(read_archives(spark, path), "archive-index")
    responses = index.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    originals = index.where("record_type = 'response' AND page_id IS NOT NULL").select(F.col("record_id").alias("o_id"), F.col("page_id").alias("o_page"), F.col("payload_bytes").alias("o_bytes"), F.col("payload_digest").alias("o_digest")).dropDuplicates(["o_id"])
    # written: hot originals then meet plain exchanges on both sides, which adaptive execution splits
    revisits = index.where("record_type = 'revisit'")
    wanted = revisits.select(F.col("refers_to_record").alias("o_id")).distinct()
    originals = written(originals.join(wanted, "o_id", "left_semi"), "originals")
    solved = revisits.join(originals, revisits["refers_to_record"] == originals["o_id"], "left").select("page_id", F.col("o_bytes").alias("payload_bytes"), F.coalesce("o_digest", "payload_digest").alias("payload_digest"), "record_type", F.col("o_page").alias("refers_to"))
    return responses.union(solved)
