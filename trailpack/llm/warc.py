"""WARC archives: written with Spark's text sink, read back by boundary-chain verification.

Writing: a record is one text row that ends with CR LF CR LF (the row separator), so every file system that Spark writes to will
do and a file is a plain WARC file. Of records with equal payloads one is a response, the others revisit it.

Reading: Spark's text source cuts a file at every ``WARC/1.0`` line, wherever it stands. A task sees the rows of a split in order,
so a row's offset is the bytes of the file's earlier splits and of the split's earlier rows. Each row is a candidate
record; the task reads its headers, emits the offset of its successor, and digests its payload if the row holds all of it. Pointer
jumping from the start of each file doubles the steps a pointer covers until no record is added: what no chain reaches is
text in a payload. A reachable record whose payload holds such text is put together from the rows that follow. Payloads are
shuffled in that case only.

Defined results: a null html is empty; a null url is an empty target; CR and LF in a url are percent-encoded. Pages with a null
page_id come last in order; if a payload has only such pages, each is a response. Of pages that repeat the smallest page_id of a
payload each is a response. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_dir, stored

# The format's marks and header names.
MAGIC, EOL = "WARC/1.0\r\n", "\r\n"
END = EOL + EOL
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: every five hex digits are four base32 digits."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def record_of_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, record (without its end): responses and revisits."""
    html = F.coalesce("html", F.lit(""))
    read = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    read = read.withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    # Counted before the shuffle; only payloads that several pages have are joined back.
    holders = (
        read.where(F.octet_length("html") >= min_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("holder"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    known = read.join(holders, "digest", "left")
    known = known.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder")))
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    is_revisit = F.isnotnull("refers_to")
    block = F.when(is_revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("html")))
    line = lambda key, value: F.concat(F.lit(key + ": "), value, F.lit(EOL))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name("page_id")),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(is_revisit, line("WARC-Refers-To", name("refers_to"))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(EOL),
        block,
    )
    return known.select("page_id", record.alias("record"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, compression: str = "gzip") -> None:
    """A compressed file is one task's to read; ``none`` gives files that Spark splits."""
    records = record_of_pages(pages, min_bytes).select("record")
    records.write.option("lineSep", END).option("compression", compression).text(path)


LENGTH = re.compile(rb"(?:^|\r\n)Content-Length: *([0-9]{1,18})(?:\r|$)")
FIELDS = {
    "record_type": re.compile(rb"(?:^|\r\n)WARC-Type: *([^\r]*)"),
    "page_id": re.compile(rb"(?:^|\r\n)WARC-Record-ID: *<urn:page:(-?[0-9]+)>"),
    "refers_to": re.compile(rb"(?:^|\r\n)WARC-Refers-To: *<urn:page:(-?[0-9]+)>"),
    "digest": re.compile(rb"(?:^|\r\n)WARC-Payload-Digest: *sha1:([^\r]*)"),
}
RECORD = "record_type string, page_id long, refers_to long, digest string, payload_bytes long, sha1 string, payload string"
ROW = f"file string, split long, within long, needs long, has long, {RECORD}, value string"


def record_of(text: bytes, keep_payload: bool) -> tuple[int | None, dict]:
    """(bytes that the record needs after its MAGIC, or None without headers; its fields if ``text`` has them all)"""
    cut = text.find(END.encode())
    length = LENGTH.search(text, 0, cut) if cut >= 0 else None
    if not length:
        return None, {}
    start, n = cut + len(END), int(length[1])
    needs = start + n + len(END)
    if needs > len(text):
        return needs, {}
    head, block = text[:cut], text[start : start + n]
    payload = block[block.find(END.encode()) + len(END) :]
    found = {k: m[1].decode() for k, p in FIELDS.items() if (m := p.search(head))}
    found |= {k: int(found[k]) for k in ("page_id", "refers_to") if k in found}
    found |= {"payload_bytes": len(payload), "sha1": base64.b32encode(hashlib.sha1(payload).digest()).decode()}
    return needs, found | ({"payload": payload.decode()} if keep_payload else {})


def table_of(rows: list[dict], schema: str) -> pd.DataFrame:
    names = {n: t for n, t in (c.split() for c in schema.split(", "))}
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype="Int64" if t == "long" else object) for n, t in names.items()})


def scanned(spark: SparkSession, path: str, keep_payload: bool) -> DataFrame:
    """One row per MAGIC in the files, in ROW's columns.

    ``value`` is left out where the row holds a record whole and lies in no longer record that began in the same split.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, within, inside = None, 0, 0
        for batch in batches:
            rows = []
            for file, split, value in zip(batch["file"], batch["split"], batch["value"], strict=True):
                if (file, split) != here:
                    here, within, inside = (file, split), 0, 0
                text = value.encode()
                needs, fields = record_of(text, keep_payload)
                if needs and not fields:
                    inside = max(inside, within + needs)
                kept = {} if fields and within >= inside else {"value": value}
                rows.append({"file": file, "split": split, "within": within, "needs": needs, "has": len(text)} | fields | kept)
                within += len(text) + len(MAGIC)
            yield table_of(rows, ROW)

    return magic_rows(spark, path).mapInPandas(scan, ROW)


def magic_rows(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def values_again(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, within, again): every row's text."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, within = None, 0
        for batch in batches:
            rows = []
            for file, split, value in zip(batch["file"], batch["split"], batch["value"], strict=True):
                here, within = (file, split), within if (file, split) == here else 0
                rows.append((file, split, within, value))
                within += len(value.encode()) + len(MAGIC)
            yield pd.DataFrame(rows, columns=["file", "split", "within", "again"])

    return magic_rows(spark, path).mapInPandas(scan, "file string, split long, within long, again string")


def candidates(spark: SparkSession, path: str, keep_payload: bool) -> DataFrame:
    """The scanned rows with ``at``, the offset of their MAGIC, and ``next``, the offset after the record."""
    rows = stored(scanned(spark, path, keep_payload))
    # The last row of a file has no MAGIC behind it, but no row follows that its size could shift.
    splits = rows.groupBy("file", "split").agg(F.sum(F.col("has") + len(MAGIC)).alias("bytes"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("start"))
    at = F.col("start") + F.col("within") - len(MAGIC)
    # Text before a file's first MAGIC is no candidate.
    rows = rows.join(splits, ["file", "split"]).withColumn("at", at).where("at >= 0")
    return rows.withColumn("next", F.col("at") + len(MAGIC) + F.col("needs")).drop("start")


def reachable(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(file, at) of the records on the chain from each file's start, from ``links`` (file, at, next)."""
    starts = links.select("file", "at")
    jumps = stored(links.select("file", "at", "next"))
    found = stored(jumps.where("at = 0").select("file", "at"))
    n = found.count()
    for _ in range(most_rounds):
        # Those found are the first 2^k records of each chain, and a jump covers 2^k.
        ahead = found.join(jumps, ["file", "at"]).select("file", F.col("next").alias("at"))
        grown = stored(found.unionByName(ahead.join(starts, ["file", "at"], "left_semi")).distinct())
        more = grown.count()
        if more == n:
            return found
        found, n = grown, more
        further = jumps.select("file", F.col("at").alias("next"), F.col("next").alias("further"))
        jumps = stored(jumps.join(further, ["file", "next"]).select("file", "at", F.col("further").alias("next")))
    raise RuntimeError("a chain did not end")


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """The records of all archives below ``path``, in RECORD's columns; payload null unless ``keep_payload``."""
    fields = [c.split()[0] for c in RECORD.split(", ")]
    rows = stored(candidates(spark, path, keep_payload))
    slim = rows.select("file", "split", "at", "next", (F.col("needs") <= F.col("has")).alias("whole"))
    chain = reachable(slim.where("next is not null").select("file", "at", "next"))
    real = rows.join(chain, ["file", "at"], "left_semi")
    simple = real.where("needs <= has").select(*fields)

    # A row belongs to the last record of the chain at or before it, in its split or an earlier one.
    marked = slim.join(chain.withColumn("start", F.col("at")), ["file", "at"], "left")
    own = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy("file", "split").agg(F.max("start").alias("last"))
    carried = carried.select("file", "split", F.max("last").over(earlier).alias("carried"))
    owned = marked.withColumn("owner", F.max("start").over(own)).join(carried, ["file", "split"])
    owned = owned.select("file", "at", F.coalesce("owner", "carried").alias("owner"))
    broken = real.where("needs > has").select("file", F.col("at").alias("owner"))
    parts = rows.join(owned.join(broken, ["file", "owner"]), ["file", "at"])
    parts = stored(parts.select("file", "split", "within", "at", "owner", "value"))
    # A record that began in an earlier split may hold rows that look whole; only then are the files read again.
    if parts.where("value is null").limit(1).count():
        again = values_again(spark, path)
        parts = parts.join(again, ["file", "split", "within"]).withColumn("value", F.coalesce("value", "again"))
    texts = (
        parts.groupBy("file", "owner")
        .agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts"))
        .select(F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC).alias("text"))
    )

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield table_of([record_of(t.encode(), keep_payload)[1] for t in batch["text"]], RECORD)

    return simple.unionByName(texts.mapInPandas(parse, RECORD))


def archive_report(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` as archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest of a response are those of the payload read; a revisit has those of the response it refers to.
    """
    spark = pages.sparkSession
    path = f"{path or scratch_dir(spark)}/archives"
    write_archives(pages, path, min_bytes)
    read = stored(read_archives(spark, path, keep_payload=False))
    responses = read.where("record_type = 'response'")
    sizes = responses.groupBy(F.col("page_id").alias("refers_to"), F.col("sha1").alias("digest")).agg(F.min("payload_bytes").alias("size"))
    revisits = read.where("record_type = 'revisit'").join(sizes, ["refers_to", "digest"], "left")
    columns = ("page_id", F.col("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to")
    return responses.select(*columns).unionByName(
        revisits.select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    )
