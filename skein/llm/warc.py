"""Content-addressed WARC archive.

The archive is two Parquet tables in one folder: `payloads` holds every distinct payload
once, under its SHA-256 and length, and `headers` holds each record's exact header bytes.
Original records are put together again by a join, and each payload is verified against its
digests on the way out.  `export` gives the same archive as byte-exact WARC records, and
`parse` reads WARC bytes written anywhere.

Records with equal payloads of at least `least` bytes: the one with the largest id is the
response and the others are revisits of it; smaller payloads are always responses.  A
null payload is empty.  Rows that repeat an id are separate records of that id; of equal
ones with the largest id, all are responses.  A null id never is the target of a revisit
unless no other id has the payload; then all are responses.  Payloads are kept whole, however
long.  An empty table gives an empty archive; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_path, only

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST = 1000
#: Records carry one fixed date, so that writing the same pages twice gives the same bytes.
DATE = "2024-01-01T00:00:00Z"


#: Of a revisit, as the WARC standard names it.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page, address):
    """The page's id and its payload's: records that repeat a page id have ids of their own unless they are equal."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), F.substring(address, 1, 16), F.lit(">"))


def _header(kind):
    """Exact bytes before a record's payload: the WARC header, and the HTTP head with which its block begins."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.octet_length(http) + F.when(kind == "revisit", F.lit(0)).otherwise(F.col("payload_bytes"))
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("address")))]
    lines += [F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " "))]
    lines += [F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest"))]
    lines += [F.when(kind == "revisit", F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to"), F.col("address")))), F.when(kind == "revisit", F.lit(f"WARC-Profile: {PROFILE}"))]
    lines += [F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), block.cast("string"))]
    return F.encode(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), http), "UTF-8")


def write_archive(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Write `payloads` and `headers` under path, from page_id, url and html."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    p = only(pages, "page_id", "url", "html").withColumn("payload", payload)
    p = p.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload")).withColumn("address", F.sha2("payload", 256))
    # One row for each payload: equal payloads meet by digest and length, combined before the shuffle.
    p.groupBy("address", "payload_bytes").agg(F.any_value("payload").alias("payload")).write.parquet(f"{path}/payloads")
    last = p.where(F.col("payload_bytes") >= least).groupBy("address", "payload_bytes").agg(F.max("page_id").alias("last"))
    r = p.drop("payload", "html").join(last, ["address", "payload_bytes"], "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    r = r.withColumn("refers_to", F.when(revisit, F.col("last"))).withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
    r = r.withColumn("header", _header(F.col("record_type")))
    r.select("page_id", "address", "payload_bytes", "header").write.parquet(f"{path}/headers")


def _field(name: str):
    return F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r]*)\r\n", 1)


def read_archive(spark, path: str) -> DataFrame:
    """Records rebuilt from both tables: header fields, the full payload and whether it matches its digests."""
    heads = spark.read.parquet(f"{path}/headers")
    goods = spark.read.parquet(f"{path}/payloads")
    r = heads.join(goods, ["address", "payload_bytes"])
    ident = F.regexp_extract(_field("WARC-Record-ID"), "<urn:page:([^:>]*)", 1)
    refers = F.regexp_extract(_field("WARC-Refers-To"), "<urn:page:([^:>]*)", 1)
    return r.select(
        F.when(ident != "none", ident.cast("long")).alias("page_id"), _field("WARC-Target-URI").alias("url"), "payload", F.length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), _field("WARC-Type").alias("record_type"), F.when(refers != "", refers.cast("long")).alias("refers_to"),
        ((F.sha2("payload", 256) == F.col("address")) & (F.sha1("payload") == F.regexp_extract(_field("WARC-Payload-Digest"), "sha1:(.*)", 1))).alias("verified"), "header",
    )


def export(records: DataFrame) -> DataFrame:
    """`record`: the exact WARC bytes of each record; a revisit's block is its HTTP head alone."""
    body = F.when(F.col("record_type") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return records.select("page_id", F.concat("header", body, F.encode(F.lit("\r\n\r\n"), "UTF-8")).alias("record"))


def parse(data: bytes) -> list[tuple[dict, bytes, bytes]]:
    """Header fields, exact header bytes and block of every record in WARC bytes."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        head = data[at:end]
        fields = {k.decode().lower(): v.decode() for k, v in re.findall(rb"\r\n([^:\r]+): ?([^\r]*)", head)}
        size = int(fields["content-length"])
        out.append((fields, head, data[end : end + size]))
        at = end + size + 4
    return out


def archive(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write the pages' archive to the shared folder, read it back and return its verified records.

    The archive is the product, so it stays there; `write_archive` takes a path of the caller's."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archive(pages, path, least)
    r = read_archive(spark, path)
    bad = F.raise_error(F.concat(F.lit("payload fails its digest: "), F.col("payload_digest")))
    return r.select("page_id", "payload_bytes", F.when(F.col("verified"), F.col("payload_digest")).otherwise(bad.cast("string")).alias("payload_digest"), "record_type", "refers_to", "url")
