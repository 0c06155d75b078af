"""Derived WARC records: linked metadata and plain-text conversions of responses.

Each response gives a ``metadata`` and a ``conversion`` record.  Both refer to it by WARC-Refers-To, repeat its
target, date and payload digest, and have block digests of their own.  Character references and links are read in
Python, as are compressed WARC files; the rest is expressed in DataFrame functions.

Defined cases: null bodies count as empty; null URLs as empty targets; repeated responses give records each; records
other than responses are passed over; an empty table gives an empty result; other columns are ignored.  A record that
is cut off, has no usable length, or lies behind a broken gzip member is no response: ``read_responses`` gives a row
that says so in ``damage``, by which such records are counted, and ``derive_records`` passes over it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as html5
import io
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import prepare

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RESPONSE_SCHEMA = "record_id string, target_uri string, date string, http_header string, body string, source_payload_digest string, source_block_digest string, damage string"
#: Bytes of bodies that a batch of read responses holds, beside its last one.
BATCH_BYTES = 8 << 20
#: Elements whose contents are no text, elements that end a line, and the named characters that the query's SQL spells out.
HIDDEN = r"(?is)<!--.*?-->" + "".join(rf"|<{e}\b.*?</{e}\s*>" for e in ("script", "style", "noscript", "template"))
LINES = r"(?i)</?(p|div|br|hr|h[1-6]|li|ul|ol|tr|table|section|article|header|footer|nav|title|blockquote|pre)\b[^>]*>"
NAMED = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
#: A link's target in double, single or no quotes; quoted values of other attributes are stepped over.
LINK = r"""(?i)<a(?=\s)(?:[^>"']|"[^"]*"|'[^']*')*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def sha1_digest(text: Column) -> Column:
    """``sha1:`` and the base-32 digest of the UTF-8 bytes."""
    ten = [F.conv(F.substring(F.sha1(text), 10 * i + 1, 10), 16, 10).cast("long") for i in range(4)]  # 40 bits, eight letters each
    letters = [F.substring(F.lit(BASE32), (F.shiftrightunsigned(v, k).bitwiseAND(F.lit(31).cast("long")) + 1).cast("int"), F.lit(1)) for v in ten for k in range(35, -1, -5)]
    return F.concat(F.lit("sha1:"), *letters)


def responses_of_pages(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", body_column: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages; record ids are made from the page's id and URL."""
    body, url = F.coalesce(body_column, F.lit("")), F.coalesce(url_column, F.lit(""))
    h = F.md5(F.concat_ws(" ", F.coalesce(F.col(id_column).cast("string"), F.lit("")), url))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    header = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"), url.alias("target_uri"),
        F.lit(date).alias("date"), header.alias("http_header"), body.alias("body"),
    )


def unescape_udf():
    """Column function: all named and numeric character references of HTML5, and no-break spaces as spaces."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: html5.unescape(v).replace("\xa0", " "), na_action="ignore")

    return run


def links_udf():
    """Column function: decoded targets of a page's links, white space inside them as in URLs left out at the ends."""

    @F.pandas_udf("array<string>")
    def run(x: pd.Series) -> pd.Series:
        link = re.compile(LINK)
        return x.map(lambda v: [re.sub(r"[\r\n\t]+", "", html5.unescape(next((g for g in m.groups() if g is not None), ""))).strip() for m in link.finditer(v)])

    return run


def plain_text(html: Column, short: bool = False) -> Column:
    """Text of a page: hidden elements out, line breaks at blocks, tags out, references decoded, lines trimmed."""
    text = F.regexp_replace(html, HIDDEN, " ")
    text = F.regexp_replace(text, LINES, "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    if short:
        for name, char in NAMED:
            text = F.replace(text, F.lit(name), F.lit(char))
    else:
        text = unescape_udf()(text)
    text = F.regexp_replace(text, r"[ \t\r\f]+", " ")
    return F.trim(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def derive_records(responses: DataFrame, short: bool = False) -> DataFrame:
    """A metadata and a conversion record for each response.

    record_id, record_type, refers_to, target_uri, date, content_type, content_length, block_digest, payload_digest
    (the response's own, else of its body), source_header (its HTTP header), n_links, block, and source_block_digest
    where responses have it.  With ``short``, what the query's SQL
    can say: references of ``NAMED`` in the text alone, and links in double quotes.
    """
    prepare(responses.sparkSession)
    if "damage" in responses.columns:
        responses = responses.filter(F.col("damage").isNull())
    body = F.coalesce("body", F.lit(""))
    title = F.trim(F.regexp_extract(body, r"(?is)<title[^>]*>(.*?)</title", 1))
    links = F.regexp_extract_all(body, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    if not short:
        title, links = F.trim(F.regexp_replace(unescape_udf()(title), r"\s+", " ")), links_udf()(body)
    base = responses.select(
        "record_id", F.coalesce("target_uri", F.lit("")).alias("target_uri"), "date", F.coalesce("http_header", F.lit("")).alias("source_header"),
        F.coalesce("source_payload_digest", sha1_digest(body)).alias("payload_digest") if "source_payload_digest" in responses.columns else sha1_digest(body).alias("payload_digest"),
        *[c for c in ("source_block_digest",) if c in responses.columns], title.alias("title"), links.alias("links"), plain_text(body, short).alias("text"),
    )
    meta = F.concat(
        F.lit("title: "), F.col("title"), F.lit("\r\nsource-status: "), F.regexp_extract("source_header", r"^HTTP/[0-9.]+ ([0-9]+)", 1), F.lit("\r\n"),
        F.array_join(F.transform("links", lambda x: F.concat(F.lit("outlink: "), x, F.lit("\r\n"))), ""),
    )
    two = F.explode(F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), meta.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), F.col("text").alias("block")),
    ))
    out = base.withColumn("d", two)
    h = F.md5(F.concat_ws(" ", "d.record_type", "record_id"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return out.select(
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"), F.col("d.record_type").alias("record_type"),
        F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("d.content_type").alias("content_type"),
        F.octet_length("d.block").cast("long").alias("content_length"), sha1_digest(F.col("d.block")).alias("block_digest"), "payload_digest",
        "source_header", F.size("links").cast("long").alias("n_links"), F.col("d.block").alias("block"), *[c for c in ("source_block_digest",) if c in responses.columns],
    )


def field_value(value: object) -> str:
    """A value that stays within its header line: control characters are percent-encoded, as a URI has them."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value)).strip()


def write_warc(records: DataFrame, path: str) -> DataFrame:
    """Write derived records as gzipped WARC files (a member a record); returns the manifest (file, n_records).

    Null and empty fields are left out, and no value can begin a line of its own (``field_value``).  The length is
    that of the block as it is written.
    The response's HTTP header and block digest are kept as WARC-Source-HTTP-Header (a JSON string, so that it is one
    line) and WARC-Source-Block-Digest.
    """
    prepare(records.sparkSession)
    names = ["record_id", "record_type", "refers_to", "target_uri", "date", "content_type", "content_length", "block_digest", "payload_digest", "block"]
    fields = ["WARC-Record-ID", "WARC-Type", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "Content-Type", "Content-Length", "WARC-Block-Digest", "WARC-Payload-Digest"]

    sources = [c for c in ("source_header", "source_block_digest") if c in records.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        where.create_dir(root, recursive=True)
        name, n = os.path.join(root, f"derived-{uuid.uuid4().hex}.warc.gz"), 0
        with where.open_output_stream(name, compression=None) as out:  # by its name, Arrow would compress it once more
            for b in batches:
                for row in b.to_pylist():
                    block = (row["block"] or "").encode()
                    values = {f: len(block) if k == "content_length" else field_value("" if row[k] is None else row[k]) for f, k in zip(fields, names, strict=False)}
                    head = "".join(f"{f}: {v}\r\n" for f, v in values.items() if v != "")
                    if row.get("source_header"):
                        head += f"WARC-Source-HTTP-Header: {json.dumps(row['source_header'])}\r\n"
                    if row.get("source_block_digest"):
                        head += f"WARC-Source-Block-Digest: {field_value(row['source_block_digest'])}\r\n"
                    out.write(gzip.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n", mtime=0))
                    n += 1
        if n:
            yield pa.RecordBatch.from_pydict({"file": [name], "n_records": pa.array([n], pa.int64())})

    return records.select(*names, *sources).mapInArrow(run, "file string, n_records long")


def records_of(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes | None, str | None]]:
    """Header fields, block and damage of each response of a WARC file, plain or gzipped; one record is held at a time.

    A damaged record has no block.  After one of no usable length, reading goes on at the next record's first line;
    what follows a cut or a broken gzip member is lost, and one entry stands for it.
    """
    source = io.BufferedReader(stream, 1 << 16)
    data = gzip.GzipFile(fileobj=source) if source.peek(2)[:2] == b"\x1f\x8b" else source
    head: dict[str, str] = {}
    try:
        while line := data.readline():
            if not line.startswith(b"WARC/1."):
                continue
            raw = []
            while (line := data.readline()) and line not in (b"\r\n", b"\n"):
                raw.append(line)
            head = {k.lower(): v for k, v in re.findall(r"(?m)^([^:\r\n]+):[ \t]*([^\r\n]*)", b"".join(raw).decode("utf-8", "replace"))}
            length = head.get("content-length", "").strip()
            if not re.fullmatch(r"[0-9]{1,15}", length):
                yield head, None, "no usable length"
                continue
            left = int(length)
            if head.get("warc-type") == "response":
                block = data.read(left)
                yield (head, block, None) if len(block) == left else (head, None, "cut off")
            else:
                while left and (part := data.read(min(left, 1 << 20))):
                    left -= len(part)
                if left:
                    yield head, None, "cut off"
    except (EOFError, OSError, zlib.error) as e:
        yield head, None, f"broken compression: {type(e).__name__}"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; what isn't chunked after all stays as it is."""
    out, at = [], 0
    while match := re.compile(rb"[ \t]*([0-9A-Fa-f]+)[^\r\n]*\r?\n").match(body, at):
        n = int(match[1], 16)
        if not n:
            return b"".join(out)
        out.append(body[match.end() : match.end() + n])
        at = match.end() + n
        at += 2 if body[at : at + 2] == b"\r\n" else 1 if body[at : at + 1] == b"\n" else 0
    return b"".join(out) if out else body


def inflated(body: bytes, coding: str) -> bytes:
    """The content of a gzip or deflate body, as far as it goes; other codings stay as they are."""
    for name in reversed([c.strip().lower() for c in coding.split(",")]):
        if name in ("gzip", "x-gzip", "deflate"):
            for bits in ((47,) if "gzip" in name else (15, -15)):
                try:
                    out, rest = [], body
                    while rest:
                        z = zlib.decompressobj(bits)
                        out.append(z.decompress(rest))
                        rest = z.unused_data if z.eof and z.unused_data[:2] == b"\x1f\x8b" else b""
                    body = b"".join(out)
                    break
                except zlib.error:
                    continue
    return body


def decoded(content: bytes, content_type: str) -> str:
    """Text by byte order mark, the header's charset or the page's own; UTF-8 where there is none, or no such charset."""
    named = re.search(r"(?i)charset\s*=\s*[\"']?([\w.:-]+)", content_type) or re.search(r"(?i)<meta[^>]+charset\s*=\s*[\"']?([\w.:-]+)", content[:4096].decode("latin-1"))
    charset = "utf-8-sig" if content[:3] == b"\xef\xbb\xbf" else "utf-16" if content[:2] in (b"\xff\xfe", b"\xfe\xff") else named[1] if named else "utf-8"
    if charset.lower() in ("iso-8859-1", "latin-1", "latin1", "ascii", "us-ascii"):
        charset = "cp1252" if not re.search(rb"[\x81\x8d\x8f\x90\x9d]", content) else "latin-1"  # as browsers read these names
    try:
        return content.decode(charset, "replace")
    except (LookupError, ValueError):
        return content.decode("utf-8", "replace")


def response_row(head: dict[str, str], block: bytes | None, damage: str | None) -> tuple[str | None, ...]:
    """A row of ``RESPONSE_SCHEMA``: the source's digests where it has them, else those of its bytes."""
    if block is None:
        return (head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"), None, None, None, None, damage)
    http, _, body = block.partition(b"\r\n\r\n")
    try:
        header = http.decode("utf-8")
    except UnicodeDecodeError:
        header = http.decode("latin-1")
    fields = {k.lower(): v for k, v in re.findall(r"(?m)^([^:\r\n]+):[ \t]*([^\r\n]*)", header)}
    payload = unchunked(body) if "chunked" in fields.get("transfer-encoding", "").lower() else body
    sha1 = lambda data: "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
    text = decoded(inflated(payload, fields.get("content-encoding", "")), fields.get("content-type", ""))
    return (head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"), header + "\r\n\r\n", text, head.get("warc-payload-digest") or sha1(payload), head.get("warc-block-digest") or sha1(block), None)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files, plain or gzipped; each file is one task, read as a stream in bounded batches.

    Files of a store that Arrow can't open come whole from Spark's reader, which ends at 2 GB a file.
    """
    prepare(spark)
    names = [f.split()[0] for f in RESPONSE_SCHEMA.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source in b.column(0).to_pylist():
                if isinstance(source, str):
                    where, name = pafs.FileSystem.from_uri(source)
                    stream = where.open_input_file(name)
                else:
                    stream = io.BytesIO(source)
                rows, held = [], 0
                with stream:
                    for head, block, damage in records_of(stream):
                        rows.append(response_row(head, block, damage))
                        held += len(rows[-1][4] or "")
                        if held >= BATCH_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                yield batch(rows)

    files = spark.read.format("binaryFile").load(path)
    one = files.select("path").first()
    try:
        pafs.FileSystem.from_uri(one.path if one else "file:///")
        column = "path"
    except (pa.ArrowInvalid, OSError):
        column = "content"
    return files.select(column).mapInArrow(run, RESPONSE_SCHEMA)
