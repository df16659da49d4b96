"""A content-addressed WARC archive: payloads once by digest, record headers by themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

#: Smaller payloads are stored once as well, but never make a revisit record.
REVISIT_BYTES = 1000
CRLF = "\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def quoted(text: Column) -> Column:
    """A header value on one line: percent, control characters and line breaks escaped."""
    for raw, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unquoted(text: Column) -> Column:
    for raw, code in (("\n", "%0A"), ("\r", "%0D"), ("%", "%25")):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def write_archive(
    pages: DataFrame,
    path: str,
    *,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    date: str = "2000-01-01T00:00:00Z",
    revisit_bytes: int = REVISIT_BYTES,
) -> None:
    """Write ``path/payloads`` and ``path/records``.

    A payload (the html in UTF-8; NULL is empty) is stored once under its SHA-256, with its
    SHA-1 for the WARC header and its length.  A record is its exact WARC header block, as
    bytes, and the SHA-256 of its payload.  Of the records that share a payload of at least
    ``revisit_bytes`` that with the largest key is the response and the others are revisits.

    The response of a digest is a map-side maximum; the texts are shuffled once, to the rows
    that hold a payload for all its copies.  A payload with very many copies is one row of a
    unique side of a join, so its copies are split over tasks.

    Defined results: a NULL key sorts below every other and its record id is
    ``<urn:page:none>``; a NULL url has no target header; rows that repeat the largest key
    of a payload are all responses; an empty table makes an empty archive.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    own = pages.select(
        F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    named = own.select(
        "page", "url", "digest", F.unhex(F.sha1("payload")).alias("sha1"),
        F.octet_length("payload").cast("long").alias("bytes"),
    )
    named = materialise(named, "warc-names")
    holders = named.groupBy("digest").agg(F.max("page").alias("holder"))
    shared = named.join(holders, "digest")
    revisit = (F.col("bytes") >= revisit_bytes) & (F.col("page") < F.col("holder")) | (
        (F.col("bytes") >= revisit_bytes) & F.col("page").isNull() & F.col("holder").isNotNull()
    )
    sha1 = F.lower(F.hex("sha1"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", quoted(F.col("url"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.when(
            revisit,
            F.concat(
                line("WARC-Refers-To", record_id(F.col("holder"))),
                line("WARC-Profile", F.lit(REVISIT_PROFILE)),
            ),
        ).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response" + CRLF),
        line(
            "Content-Length",
            (F.when(revisit, 0).otherwise(F.col("bytes")) + len(HTTP)).cast("string"),
        ),
        F.lit(CRLF),
    )
    records = shared.select(F.encode(head, "UTF-8").alias("header"), "digest")
    records.write.option("compression", "zstd").parquet(f"{path}/records")
    # One row per digest holds the payload: the holder's; where its key repeats, one of them.
    # Both steps hash by (digest, key), so payloads are shuffled once.
    place = F.coalesce("page", F.lit(-(2**63))).alias("place")
    pick = named.groupBy("digest", "sha1", "bytes").agg(F.max("page").alias("page"))
    pick = pick.select("digest", place, "sha1", "bytes")
    held = own.select("digest", place, "payload").join(pick, ["digest", "place"])
    held = held.dropDuplicates(["digest", "place"]).drop("place")
    held.write.option("compression", "zstd").parquet(f"{path}/payloads")


def field(header: Column, name: str) -> Column:
    """The value of a header line, NULL if the record has none."""
    found = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(F.contains(header, F.lit(f"{CRLF}{name}: ")), found)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record, whole again: its exact header, its payload and the parsed fields.

    ``record`` is the WARC record as it would lie in a file (a revisit's block is the HTTP
    head alone).  ``payload`` is the full payload also of a revisit, and ``payload_digest``
    the SHA-1 recomputed from the stored bytes.  A stored payload whose bytes no longer give
    its SHA-256 fails the read, and so does a record whose payload is missing or whose header
    names another SHA-1.
    """
    stored = spark.read.parquet(f"{path}/payloads")
    good = (F.unhex(F.sha2("payload", 256)) == F.col("digest")) & (
        F.octet_length("payload") == F.col("bytes")
    )
    checked = stored.select(
        "digest", "payload",
        F.when(good, F.sha1("payload")).otherwise(
            F.raise_error(F.lit("a stored payload does not match its digest")).cast("string")
        ).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )
    records = spark.read.parquet(f"{path}/records")
    whole = records.join(checked, "digest", "left")
    text = F.decode("header", "UTF-8")
    is_revisit = field(text, "WARC-Type") == "revisit"
    body = F.when(is_revisit, F.lit(b"")).otherwise(F.col("payload"))
    named = F.concat(F.lit("sha1:"), F.col("payload_digest"))
    agreed = F.when(field(text, "WARC-Payload-Digest") == named, F.col("payload_digest")).otherwise(
        F.raise_error(F.lit("a record's payload is missing or another")).cast("string")
    )
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1)
    page = lambda c: F.when(number(c) != "", number(c)).cast("long")
    return whole.select(
        page(field(text, "WARC-Record-ID")).alias("page_id"),
        unquoted(field(text, "WARC-Target-URI")).alias("url"),
        field(text, "WARC-Type").alias("record_type"),
        page(field(text, "WARC-Refers-To")).alias("refers_to"),
        agreed.alias("payload_digest"),
        "payload_bytes",
        "header",
        "payload",
        F.concat("header", F.lit(HTTP.encode()), body, F.lit(b"\r\n\r\n")).alias("record"),
    )
