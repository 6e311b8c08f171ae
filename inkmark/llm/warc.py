"""WARC archives with revisit records instead of repeated payloads."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmark.llm.common import stored

_END = "\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolve(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """(page_id, digest, refers_to): the pages whose payload of `least_bytes` or more an earlier page_id has too.

    Only headers are shuffled, by digest: the least page_id of a digest is a partial aggregate, and joined back to
    the digests that occur more than once.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    heads = pages.where(F.octet_length(html) >= least_bytes).select("page_id", F.sha2(html, 256).alias("digest")).where("page_id is not null")
    first = heads.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return heads.join(first, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def _id(archive: str, page_id: Column, digest: Column) -> Column:
    """A record's id: another one in each archive, for each page and for each payload."""
    h = F.md5(F.concat_ws(" ", F.lit(archive), F.coalesce(page_id.cast("string"), F.lit("")), digest))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _opening(archive: str) -> str:
    return f"WARC/1.1\r\nWARC-Warcinfo-ID: <urn:uuid:{archive}>\r\n"


def _info(archive: str, date: str) -> str:
    """The warcinfo record that the other records name."""
    block = _END.join(["software: inkmark", "format: WARC File Format 1.1", "description: revisits instead of repeated payloads", ""])
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{archive}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return _END.join([*head, "", block])


def records(pages: DataFrame, revisits: DataFrame, date: str, archive: str) -> DataFrame:
    """(value): each page as the text of a WARC 1.1 record without the two line ends that close it.

    A page is a revisit by its id and its payload's digest: a row that repeats a page_id with another payload keeps it.
    """
    known = revisits.select(F.col("page_id").alias("known_page"), F.col("digest").alias("known_digest"), "refers_to")
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html"), 256))
    p = p.join(known, (F.col("page_id") == F.col("known_page")) & (F.col("digest") == F.col("known_digest")), "left")
    digest, again = F.col("digest"), F.col("refers_to").isNotNull()
    block = F.concat(F.lit(_HTTP), F.when(again, F.lit("")).otherwise(F.col("html")))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", " ")

    def line(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(_END))

    head = F.concat(
        F.lit(_opening(archive)),
        F.when(again, line("WARC-Type", "revisit")).otherwise(line("WARC-Type", "response")),
        line("WARC-Record-ID", _id(archive, F.col("page_id"), digest)),
        line("WARC-Date", date),
        line("WARC-Target-URI", url),
        line("WARC-Page-Id", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.when(again, F.concat(line("WARC-Profile", _PROFILE), line("WARC-Refers-To", _id(archive, F.col("refers_to"), digest)), line("WARC-Refers-To-Page-Id", F.col("refers_to").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", "application/http; msgtype=response"),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    return p.select(F.concat(head, F.lit(_END), block).alias("value"))


def write(pages: DataFrame, path: str, *, least_bytes: int = 100, records_a_file: int = 20_000) -> str:
    """Writes gzip-compressed archives below path, by Spark's own writer, and gives the id that their records carry.

    Null html is an empty payload. Pages without an id are responses; so are all with a payload under least_bytes.
    Of equal payloads the smallest page_id is the response (rows that repeat that id with it are responses, too).
    Payloads are written whole, whatever their length; other columns of pages, of any name, are left alone. An empty
    table writes an archive with its warcinfo record alone, which has a file of its own beside those of the pages. A
    record's id is drawn from archive, page_id and digest: only rows that repeat both page_id and payload share one. Each
    file, of up to records_a_file records, is one gzip stream: files are read whole, in parallel, records can't be sought.
    """
    revisits = stored(resolve(pages, least_bytes), "revisits")
    archive = str(uuid.uuid4())
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    info = pages.sparkSession.range(0, 1, 1, 1).select(F.lit(_info(archive, date)).alias("value"))
    rows = records(pages, revisits, date, archive).unionByName(info)
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_a_file).text(path)
    return archive


def read(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every response and revisit below path.

    Records are told apart by the line that names their archive, which no payload can hold, as it is drawn anew for
    each. A record's block has the length that its header says. Responses are measured by the payload that was read;
    a revisit has the digest of its own header, and its length from the response that it refers to. Where a header has
    no number as the page's id, that of the page referred to, or the length, the value is null, and so is what follows
    from it.
    """
    rows = spark.read.option("lineSep", f"{_END}{_END}{_opening(archive)}").option("pathGlobFilter", "*.gz").text(path)
    whole = F.regexp_replace("value", "^" + _opening(archive).replace(".", "\\."), "")
    head = F.concat(F.lit(_END), F.substring_index(whole, _END * 2, 1), F.lit(_END))

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract("head", f"\\r\\n{name}: ([^\\r]*)\\r\\n", 1), F.lit(""))

    data = F.encode("whole", "UTF-8")
    own = rows.select(whole.alias("whole"), head.alias("head"))
    length = field("Content-Length").try_cast("int") - len(_HTTP)
    payload = F.substring(data, F.octet_length("head") + 1 + len(_HTTP), length)
    again = field("WARC-Type") == "revisit"
    found = own.select(
        field("WARC-Page-Id").try_cast("long").alias("page_id"),
        F.when(~again, length.cast("long")).alias("payload_bytes"),
        F.when(again, F.substring_index(field("WARC-Payload-Digest"), ":", -1)).otherwise(F.sha2(payload, 256)).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Refers-To-Page-Id").try_cast("long").alias("refers_to"),
    )
    found = stored(found.where("record_type in ('response', 'revisit')"), "records")
    own = found.where("record_type = 'response'")
    lengths = own.where("page_id is not null").select(F.col("page_id").alias("__page"), F.col("payload_digest").alias("__digest"), F.col("payload_bytes").alias("__bytes")).distinct()
    again = found.where("record_type = 'revisit'").join(lengths, (F.col("refers_to") == F.col("__page")) & (F.col("payload_digest") == F.col("__digest")), "left")
    again = again.select("page_id", F.col("__bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return own.unionByName(again)
