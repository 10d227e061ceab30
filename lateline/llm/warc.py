"""Legacy ARC archives converted to WARC.

An ARC file is a version block and records, each a header line, the number of
bytes the line declares, and a line feed. Version 1 lines have five fields (URL,
IP address, date, type, length), version 2 lines ten (URL, IP address, date, type,
result code, checksum, location, offset, file name, length); the version block's
second line says which one it is. The converter reads the declared lengths, never
a separator inside a body, and makes up what WARC wants beyond them: a name-based
record identifier, a date with separators, a type, and SHA-1 digests.

Archives are written by Spark's text writer, one record per row, so they can lie
in any store Spark can write to, and read back file by file. A file holds at most
FILE_RECORDS records, which bounds what a reader task holds at a time.
"""

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from lateline.llm.common import map_batches
from lateline.sources.staging import new_path, settle

REVISIT_BYTES = 1000  # smaller payloads are stored each time
FILE_RECORDS = 500
ARC_DATE = "20240115093000"
PAGE_HEADER = "X-Page-Id"
_END = "\r\n\r\n"
_V1 = "URL IP-address Archive-date Content-type Archive-length"
_V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

# ---- ARC ---------------------------------------------------------------------


def arc_records(pages):
    """One ARC record per row of `pages` (page_id, url, html) as column `value`, with its file's `version`.

    Rows of odd page_id make version 2 records, the others version 1. The page_id
    stands in a header of the archived response. A null html is an empty body, a
    null or empty url is written as "-", white space in it is escaped.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit(f"{PAGE_HEADER}: "), F.col("page_id").cast("string"), F.lit("\r\n"))).otherwise(""),
        F.lit("\r\n"),
    )
    url = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\s\p{Cntrl}]", "%20")
    url = F.when(url == "", F.lit("-")).otherwise(url)
    version = F.when(F.coalesce(F.col("page_id").cast("long") % 2, F.lit(0)) == 0, 1).otherwise(2)
    length = (F.octet_length(head) + F.octet_length(body)).cast("string")
    first = F.concat_ws(" ", url, F.lit("0.0.0.0"), F.lit(ARC_DATE), F.lit("text/html"))
    second = F.concat_ws(" ", F.lit("200"), F.lit("-"), F.lit("-"), F.lit("0"), F.lit("pages.arc"))
    line = F.when(version == 1, F.concat_ws(" ", first, length)).otherwise(F.concat_ws(" ", first, second, length))
    return pages.select(version.alias("version"), F.concat(line, F.lit("\n"), head, body).alias("value"))


def version_block(version):
    """The block that opens an ARC file, without its closing line feed."""
    body = f"{version} 0 archive\n{_V1 if version == 1 else _V2}\n"
    rest = "" if version == 1 else "200 - - 0 pages.arc "
    return f"filedesc://pages.arc 0.0.0.0 {ARC_DATE} text/plain {rest}{len(body)}\n{body}"


def write_arc(pages, path, file_records=FILE_RECORDS):
    """ARC files of `pages` below `path`/version=N; each file opens with its version block."""

    records = arc_records(pages)
    for version in (1, 2):

        def with_blocks(batches, version=version):
            number = 0
            for batch in batches:
                values = []
                for value in batch.column(0).to_pylist():
                    if number % (file_records - 1) == 0:
                        values.append(version_block(version))
                    values.append(value)
                    number += 1
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["value"])

        part = records.where(F.col("version") == version).select("value").mapInArrow(with_blocks, "value string")
        writer = part.write.option("lineSep", "\n").option("compression", "gzip")
        writer.option("maxRecordsPerFile", file_records).text(f"{path}/version={version}")


def read_records(spark, path):
    """(content) of every archive file at or below `path`, unzipped where it is zipped."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")


def unzipped(content):
    """The bytes of a gzip file of any number of members; others as they are."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content) + member.flush())
        content = member.unused_data.lstrip(b"\0")
    return b"".join(out)


class BadArchive(ValueError):
    """A header line or a declared length that does not fit the file."""


def parse_arc(content):
    """Records of an ARC file as dicts: url, ip, date, mime, status, block; the version block included.

    A header line with another number of fields than the version says, or a length
    that passes the end of the file, raises BadArchive: bytes are never guessed.
    """
    at, fields = 0, 5
    while at < len(content):
        end = content.find(b"\n", at)
        if end < 0:
            raise BadArchive(f"no header line at byte {at}")
        if end == at:  # an empty line between records
            at += 1
            continue
        parts = content[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        opening = parts[0].startswith("filedesc://")
        if len(parts) != fields and not (opening and len(parts) in (5, 10)) or not parts[-1].isdigit():
            raise BadArchive(f"header line at byte {at} has {len(parts)} fields")
        length = int(parts[-1])
        block = content[end + 1 : end + 1 + length]
        if len(block) < length:
            raise BadArchive(f"record at byte {at} declares {length} bytes, {len(block)} are left")
        if opening:
            fields = 10 if block[:1] == b"2" else 5
        yield {"url": parts[0], "ip": parts[1], "date": parts[2], "mime": parts[3], "status": parts[4] if len(parts) == 10 else None, "block": block}
        at = end + 1 + length


# ---- ARC to WARC ---------------------------------------------------------------


def _payload_of(block):
    """An HTTP response's header and payload; a block that is none has no header."""
    if block[:5] == b"HTTP/":
        at = block.find(b"\r\n\r\n")
        if at >= 0:
            return block[: at + 4], block[at + 4 :]
    return b"", block


def _page_id(header):
    """The page number an HTTP header carries, None if there is none."""
    for line in header.decode("utf-8", "replace").split("\r\n"):
        name, _, value = line.partition(": ")
        if name == PAGE_HEADER:
            return int(value)
    return None


def warc_date(date):
    """14 digits with separators; shorter dates are filled up with the first moment they allow."""
    digits = (date + "00000101000000"[len(date) :])[:14] if date.isdigit() else "00000101000000"
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def warc_type(record):
    """filedesc records become warcinfo, HTTP responses response, everything else resource."""
    if record["url"].startswith("filedesc://"):
        return "warcinfo"
    return "response" if record["block"][:5] == b"HTTP/" else "resource"


_CONVERTED = "page_id long, url string, date string, type string, mime string, ip string, header binary, payload binary, payload_bytes long, digest string"


def converted(spark, path):
    """WARC fields of every ARC record below `path`, warcinfo records apart."""

    def batch_of(batch):
        rows = []
        for content in batch.column(0).to_pylist():
            for record in parse_arc(unzipped(content)):
                kind = warc_type(record)
                if kind == "warcinfo":
                    continue
                header, payload = _payload_of(record["block"])
                rows.append(
                    (_page_id(header), record["url"], warc_date(record["date"]), kind, record["mime"], record["ip"],
                     header, payload, len(payload), hashlib.sha1(payload).hexdigest())
                )
                if len(rows) >= 200:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    return map_batches(read_records(spark, path), batch_of, _CONVERTED)


def _batch(rows):
    kinds = [pa.int64(), *[pa.string()] * 5, pa.binary(), pa.binary(), pa.int64(), pa.string()]
    names = [part.split(" ")[0] for part in _CONVERTED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def with_revisits(records):
    """Records with `keeper`: of equal payloads of at least REVISIT_BYTES, all but the one of the largest page_id name it.

    A record without page_id is stored each time. The payloads themselves take no part in the grouping: digests are counted, and
    only digests that stand more than once are joined back.
    """
    large = records.where((F.col("payload_bytes") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
    first = F.max(F.struct("page_id", "url", "date")).alias("keeper")
    largest = large.groupBy("digest").agg(first, F.count("*").alias("n"))
    largest = settle(largest.where("n > 1").select("digest", "keeper"), "revisits")
    refers = (F.col("payload_bytes") >= REVISIT_BYTES) & (F.col("keeper.page_id") != F.col("page_id"))
    return records.join(largest, "digest", "left").withColumn("keeper", F.when(refers, F.col("keeper")))


def _record_id(page_id, url, date):
    """An identifier named by what the record holds, so it is the same in every run and a reference needs no lookup."""
    name = F.sha1(F.concat_ws(" ", url, date, F.col("digest"), page_id.cast("string")))
    parts = [F.substring(name, 1, 8), F.substring(name, 9, 4), F.concat(F.lit("5"), F.substring(name, 14, 3))]
    parts += [F.concat(F.lit("8"), F.substring(name, 18, 3)), F.substring(name, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def warc_records(records):
    """One WARC record per row, as column `value`, without the two line ends that close it."""
    revisit, keeper = F.col("keeper").isNotNull(), F.col("keeper")
    block = F.concat("header", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))
    plain = F.when(F.octet_length("header") > 0, F.lit("application/http; msgtype=response")).otherwise(F.col("mime"))
    fields = {
        "WARC-Type": F.when(revisit, F.lit("revisit")).otherwise(F.col("type")),
        "WARC-Record-ID": _record_id(F.col("page_id"), F.col("url"), F.col("date")),
        "WARC-Date": F.col("date"),
        "WARC-Target-URI": F.col("url"),
        "WARC-IP-Address": F.col("ip"),
        "WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("digest")),
        "WARC-Block-Digest": F.concat(F.lit("sha1:"), F.sha1(block)),
        "WARC-Refers-To": F.when(revisit, _record_id(keeper["page_id"], keeper["url"], keeper["date"])),
        "WARC-Refers-To-Target-URI": F.when(revisit, keeper["url"]),
        "WARC-Refers-To-Date": F.when(revisit, keeper["date"]),
        "X-Refers-To-Page-Id": F.when(revisit, keeper["page_id"].cast("string")),
        "WARC-Profile": F.when(revisit, F.lit(REVISIT_PROFILE)),
        "Content-Type": plain,
        "X-Payload-Length": F.col("payload_bytes").cast("string"),
        "Content-Length": F.octet_length(block).cast("string"),
    }
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in fields.items()]  # null where a field is left out
    head = F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines), F.lit(_END))
    return records.select(F.concat(F.encode(head, "UTF-8"), block).cast("string").alias("value"))


def write_warc(records, path, file_records=FILE_RECORDS):
    """WARC files of the records below `path`."""
    writer = warc_records(records).write.option("lineSep", _END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", file_records).text(path)


# ---- WARC ----------------------------------------------------------------------


def parse_warc(content):
    """Records of a WARC file as (headers, block); a record that does not fit its lengths raises BadArchive."""
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or content[at : at + 5] != b"WARC/":
            raise BadArchive(f"no record at byte {at}")
        headers = {}
        for line in content[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(": ")
            headers[name] = value
        length = int(headers["Content-Length"])
        block = content[end + 4 : end + 4 + length]
        if len(block) < length or content[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise BadArchive(f"record at byte {at} declares {length} bytes and does not end there")
        yield headers, block
        at = end + 8 + length


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def read_warc(spark, path):
    """One row per record below `path`.

    Length and digest of a stored payload are taken from its bytes as read, those of a
    revisited one, which is not stored, from its header. `intact` says whether block,
    payload and length agree with the headers.
    """

    def batch_of(batch):
        rows = []
        for content in batch.column(0).to_pylist():
            for headers, block in parse_warc(unzipped(content)):
                header, payload = _payload_of(block)
                kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                intact = hashlib.sha1(block).hexdigest() == headers["WARC-Block-Digest"].removeprefix("sha1:")
                length = int(headers["X-Payload-Length"])
                if kind != "revisit":
                    read = len(payload), hashlib.sha1(payload).hexdigest()
                    intact = intact and read == (length, digest)
                    length, digest = read
                refers = int(headers["X-Refers-To-Page-Id"]) if kind == "revisit" else None
                rows.append((_page_id(header), headers["WARC-Target-URI"], length, digest, kind, refers, intact))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
        names = [part.split(" ")[0] for part in _READ.split(", ")]
        columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return map_batches(read_records(spark, path), batch_of, _READ)


def convert(spark, arc_path, warc_path):
    """Convert every ARC file below `arc_path` to WARC files below `warc_path`."""
    write_warc(with_revisits(converted(spark, arc_path)), warc_path)


def query(spark, sf_dir):
    """All pages as ARC files, converted to WARC files, read back."""
    from lateline.llm.common import table

    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(table(spark, sf_dir, "pages"), arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages),
q AS (SELECT page_id, digest, strlen(html) AS n FROM p),
k AS (SELECT digest, max(page_id) AS keeper, count(*) AS c FROM q WHERE n >= {REVISIT_BYTES} GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, q.digest AS payload_digest,
       CASE WHEN n >= {REVISIT_BYTES} AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {REVISIT_BYTES} AND keeper <> page_id THEN keeper END AS refers_to, true AS intact
FROM q LEFT JOIN k ON q.digest = k.digest
"""
