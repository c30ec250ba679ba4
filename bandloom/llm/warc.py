"""WARC archives: written by Spark's text sink, read back and assembled into captures.

A capture is a request, a response (or a revisit of an equal payload) and a
metadata record that name each other by WARC-Concurrent-To.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BREAK = "\r\n"
PAGES_PER_FILE = 2000
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = (
    "file string, at bigint, type string, record_id string, concurrent_to array<string>, refers_to string, uri string, "
    "date string, payload_bytes bigint, payload_digest string, fields array<struct<name:string,value:string>>"
)


def base32_of_hex(digest: Column) -> Column:
    """Base 32 of a hexadecimal digest whose length is a multiple of 5 digits, here the 40 of SHA-1."""
    letters = []
    for at in range(0, 40, 5):
        group = F.conv(F.substring(digest, at + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            place = F.shiftright(group, shift).bitwiseAND(F.lit(31)) + 1
            letters.append(F.lit(BASE32).substr(place, F.lit(1)))
    return F.concat(*letters)


def payload_roles(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """The rows of `pages` (with their number `_row`) and digest, size, and in `_first` the smallest id with the same
    payload and the least number of its rows.

    The smallest id per digest is aggregated on narrow rows first; payloads are then
    shuffled once, to the digest, where a digest that many pages share can be split.
    """
    marked = pages.withColumn("_payload", F.coalesce(F.col(payload_col).cast("string"), F.lit("")))
    marked = marked.withColumn("_sha1", F.sha1("_payload")).withColumn("_bytes", F.octet_length("_payload").cast("bigint"))
    firsts = marked.filter(F.col("_bytes") >= min_bytes).groupBy("_sha1", "_bytes").agg(F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "_row")).alias("_first"))
    return marked.join(firsts.hint("shuffle_hash"), ["_sha1", "_bytes"], "left")


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    lines = [F.lit(f"WARC/1.1{BREAK}WARC-Type: {kind}{BREAK}WARC-Record-ID: "), record_id, F.lit(f"{BREAK}WARC-Date: {DATE}{BREAK}")]
    for name, value in headers:
        lines += [F.lit(f"{name}: "), value, F.lit(BREAK)]
    lines += [F.lit(f"Content-Type: {content_type}{BREAK}Content-Length: "), F.octet_length(block).cast("string"), F.lit(BREAK * 2), block]
    return F.concat(*lines)


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_revisit_bytes: int = 0,
    compression: str = "none",
    pages_per_file: int = PAGES_PER_FILE,
) -> None:
    """Write a request, a response or revisit, and a metadata record per page below `path`.

    Of pages with equal payloads of at least `min_revisit_bytes`, the one with the
    smallest id keeps the payload, the others refer to it. Rows that repeat that id
    with the same payload are all responses. Record ids hold the page id and the
    number of the row, so pages without an id or with a repeated one are captures of
    their own; `pages` is read twice and must number its rows alike (a table does). A
    null payload is empty; a null id is
    written without a number and is never the smallest while another page has the
    payload; line breaks are taken out of urls, a null url is empty. Files are plain
    WARC (or gzip as a whole) of at most `pages_per_file` pages, committed by
    Spark's writer, so that a lost task leaves nothing behind.
    """
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).alias("payload"), F.monotonically_increasing_id().alias("_row"))
    marked = payload_roles(pages, "id", "payload", min_revisit_bytes)
    number = F.coalesce(F.col("id").cast("string"), F.lit(""))
    name = lambda page, row: F.concat(F.coalesce(page.cast("string"), F.lit("")), F.lit("-"), row.cast("string"))
    urn = lambda kind, n: F.concat(F.lit(f"<urn:capture:{kind}:"), n, F.lit(">"))
    here = name(F.col("id"), F.col("_row"))
    url = F.coalesce(F.regexp_replace("url", "[\\r\\n]", ""), F.lit(""))
    own, digest = urn("response", here), F.concat(F.lit("sha1:"), base32_of_hex(F.col("_sha1")))
    is_first = F.col("_first").isNull() | F.col("id").eqNullSafe(F.col("_first.id"))
    head = F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK * 2}")
    target = ("WARC-Target-URI", url)
    request = _record(
        "request", urn("request", here), [target, ("WARC-Concurrent-To", own)], "application/http;msgtype=request",
        F.concat(F.lit("GET "), url, F.lit(f" HTTP/1.1{BREAK * 2}")),
    )
    response = _record(
        "response", own, [target, ("WARC-Payload-Digest", digest)], "application/http;msgtype=response", F.concat(head, F.col("_payload")),
    )
    refers = ("WARC-Refers-To", urn("response", name(F.col("_first.id"), F.col("_first._row"))))
    revisit = _record(
        "revisit", own, [target, refers, ("WARC-Profile", F.lit(REVISIT_PROFILE)), ("WARC-Payload-Digest", digest)],
        "application/http;msgtype=response", head,
    )
    metadata = _record(
        "metadata", urn("metadata", here), [target, ("WARC-Concurrent-To", own)], "application/warc-fields",
        F.concat(F.lit("pageId: "), number, F.lit(BREAK)),
    )
    records = marked.select(F.explode(F.array(request, F.when(is_first, response).otherwise(revisit), metadata)).alias("value"))
    writer = records.write.option("lineSep", BREAK * 2).option("maxRecordsPerFile", 3 * pages_per_file)
    writer.option("compression", compression).text(path)


def split_records(content: bytes) -> Iterator[tuple[int, dict[str, list[str]], bytes]]:
    """(offset, headers, block) of every record of an archive; lengths are trusted, separators checked."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        headers: dict[str, list[str]] = {}
        for line in content[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers.setdefault(name.decode().strip().lower(), []).append(value.decode().strip())
        start = end + 4
        stop = start + int(headers["content-length"][0])
        if content[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where it says")
        yield at, headers, content[start:stop]
        at = stop + 4


def _parse(with_payload: bool):
    def one(headers: dict[str, list[str]], name: str):
        return headers.get(name, [None])[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = []
                for at, headers, block in split_records(content):
                    http = one(headers, "content-type") or ""
                    fields, payload = [], block
                    if http.startswith("application/http"):
                        payload = block.partition(b"\r\n\r\n")[2]
                    elif http.startswith("application/warc-fields"):
                        pairs = (line.partition(":") for line in block.decode().split(BREAK) if line)
                        fields = [{"name": k.strip(), "value": v.strip()} for k, _, v in pairs]
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    row = (path, at, one(headers, "warc-type"), one(headers, "warc-record-id"), headers.get("warc-concurrent-to", []),
                           one(headers, "warc-refers-to"), one(headers, "warc-target-uri"), one(headers, "warc-date"), len(payload), digest, fields)
                    rows.append((*row, payload) if with_payload else row)
                names = [part.split()[0] for part in RECORDS.split(", ")] + ["payload"] * with_payload
                yield pd.DataFrame(rows, columns=names)

    return run


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives below `path`, with the size and SHA-1 (base 32) of its payload.

    An HTTP block's payload is its body. Archives may be plain or gzip. A record
    whose length or separator is wrong fails the read instead of being skipped. A
    file is parsed in one task, so files should stay far below executor memory.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0").select("path", "content")
    return files.mapInPandas(_parse(with_payload), RECORDS + (", payload binary" if with_payload else ""))


def assemble_captures(records: DataFrame, hops: int = 2) -> DataFrame:
    """One nested row per capture: capture_id, response, requests, metadata.

    The response or revisit is the root. Another record belongs to the root that it
    names, or that names it, by WARC-Concurrent-To, directly or through up to
    `hops - 1` further records; named by several, it goes to the smallest root. A
    record that reaches no root is a capture of its own without a response, so
    nothing is lost. Repeated record ids are kept as further records of the capture.
    Columns other than those of an archive are carried along in the records.
    """
    plain = [c for c in records.columns]
    root = F.col("type").isin("response", "revisit")
    roots = records.filter(root)
    links = roots.select(F.col("record_id").alias("member"), F.col("record_id").alias("capture_id")).unionByName(
        roots.select(F.explode("concurrent_to").alias("member"), F.col("record_id").alias("capture_id"))
    )
    rest = records.filter(~F.coalesce(root, F.lit(False)))
    names = rest.select("record_id", F.explode(F.array_union(F.array("record_id"), "concurrent_to")).alias("member")).distinct()
    for hop in range(hops):
        met = names.join(links, "member").groupBy("record_id").agg(F.min("capture_id").alias("capture_id"))
        if hop + 1 < hops:
            links = links.unionByName(met.select(F.col("record_id").alias("member"), "capture_id")).distinct()
    kept = rest.join(met, "record_id", "left").withColumn("capture_id", F.coalesce("capture_id", "record_id"))
    every = roots.withColumn("capture_id", F.col("record_id")).unionByName(kept.select(*plain, "capture_id"))
    body = F.struct(*plain)
    of = lambda kind: F.sort_array(F.collect_list(F.when(kind, F.struct("file", "at", body.alias("record")))))
    grouped = every.groupBy("capture_id").agg(
        of(root).alias("roots"), of(F.col("type") == "request").alias("requests"), of(~root & (F.col("type") != "request")).alias("others")
    )
    return grouped.select(
        "capture_id",
        F.get("roots", F.lit(0))["record"].alias("response"),
        F.col("requests.record").alias("requests"),
        F.concat(F.col("others.record"), F.slice("roots", 2, F.greatest(F.size("roots"), F.lit(1))).getField("record")).alias("metadata"),
    )


def page_captures(captures: DataFrame) -> DataFrame:
    """Captures as pages: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The page id is the metadata's; a revisit takes size and digest of the full
    payload from the response it refers to.
    """
    fields = F.flatten(F.col("metadata.fields"))
    page = F.get(F.filter(fields, lambda f: f["name"] == "pageId"), F.lit(0))["value"].try_cast("bigint")
    flat = captures.select(
        "capture_id", page.alias("page_id"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("refers"),
        F.col("response.payload_bytes").alias("own_bytes"), F.col("response.payload_digest").alias("own_digest"),
    )
    full = flat.filter("record_type = 'response'").select(
        F.col("capture_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("own_bytes").alias("full_bytes"), F.col("own_digest").alias("full_digest")
    )
    joined = flat.filter("record_type = 'revisit'").join(full, "refers", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    revisits = joined.withColumnsRenamed({"full_bytes": "payload_bytes", "full_digest": "payload_digest"}).select(*columns)
    responses = flat.filter("record_type = 'response'").withColumnsRenamed({"own_bytes": "payload_bytes", "own_digest": "payload_digest"})
    return responses.withColumn("refers_to", F.lit(None).cast("bigint")).select(*columns).unionByName(revisits)
