"""WARC archives: writing pages as records with segments and revisits, and reading them back.

Spark's text sink writes the records (any store will do, commits are atomic); its line separator is the two line ends
after each record. Blocks above segment_bytes become a first segment and continuation records. Reading parses whole files
by Content-Length, groups continuations by origin identifier, orders them by segment number, checks the total length and
takes off the chunked transfer framing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Fixed values of the formats: line ends, a gzip member's first bytes, a record's.
CRLF, GZIP, BEGIN = b"\r\n", b"\x1f\x8b\x08", b"WARC/"
#: A header's bytes at most, and what stands for the end of an archive.
HEADER, END = 1 << 20, object()
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
#: Fixed values of the WARC format's identical-payload-digest revisit profile.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records in a file at most; with the segment size this bounds a file, which one task reads whole.
FILE_RECORDS = 1000
RECORD = "record_id string, origin string, segment int, total long, page_id long, kind string, digest string, length long, refers long, uri string, block binary, problem string"


def chunked(payload: bytes, size: int = 8192) -> bytes:
    """The payload in chunked transfer framing."""
    out = [b"%x\r\n%b\r\n" % (len(part), part) for part in (payload[k : k + size] for k in range(0, len(payload), size))]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Takes off chunked transfer framing, chunk extensions and trailers; ValueError if it is cut short or broken."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            if body[at:] != CRLF and not body.endswith(CRLF + CRLF):  # nothing but trailers may follow
                raise ValueError("last chunk cut short")
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != CRLF:
            raise ValueError("chunk cut short")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, body = block.partition(CRLF + CRLF)
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")) else body


def record(fields: dict[str, object], block: bytes) -> bytes:
    """A record without the two line ends after it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n%b%b: %d\r\n\r\n%b" % (head.encode(), b"Content-Length", len(block), block)


def target_uri(page_id, url) -> str:
    return re.sub(r"[\x00-\x20]", "", url or "") or f"urn:page:{page_id}"


def page_records(page_id, url, html, keeper, keeper_url, digest: str, date: str, segment_bytes: int) -> list[bytes]:
    payload = (html or "").encode()
    name = f"<urn:uuid:{uuid.uuid4()}>"
    uri = target_uri(page_id, url)
    fields = {"WARC-Type": "response", "WARC-Record-ID": name, "WARC-Date": date, "WARC-Target-URI": uri, "Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-ID": page_id, "X-Payload-Length": len(payload)}
    if keeper is not None:
        return [record(fields | {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To-Target-URI": target_uri(keeper, keeper_url), "WARC-Refers-To-Date": date, "X-Refers-To-Page-ID": keeper}, HTTP_HEAD)]
    block = HTTP_HEAD + chunked(payload)
    if len(block) <= segment_bytes:
        return [record(fields, block)]
    parts = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
    out = [record(fields | {"WARC-Segment-Number": 1}, parts[0])]
    for n, part in enumerate(parts[1:], 2):
        more = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "WARC-Target-URI": uri, "WARC-Segment-Origin-ID": name, "WARC-Segment-Number": n, "WARC-Segment-Total-Length": len(block) if n == len(parts) else None}
        out.append(record(more, part))
    return out


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = 1000, segment_bytes: int = 16384, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record per row. Of rows with equal payloads of at least revisit_from bytes, those with the largest id are
    responses and the others revisit that id; rows with a null id are responses. Null html: an empty payload.

    Payloads aren't shuffled to find equal ones: only digests and lengths are, and the table of repeated payloads, written
    first, is joined back; Spark broadcasts it only while it is small.
    """
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    src = src.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "length": F.octet_length("html").cast("long")})
    groups = src.where(F.col("length") >= revisit_from).groupBy("digest", "length").agg(F.max("page_id").alias("keeper"), F.max(F.struct("page_id", "url"))["url"].alias("keeper_url"), F.count(F.lit(1)).alias("n"))
    repeated = materialize(groups.where("n > 1 AND keeper IS NOT NULL").select(F.col("digest").alias("d"), F.col("length").alias("l"), "keeper", "keeper_url"), "warc-repeated")
    named = src.join(repeated, (F.col("digest") == F.col("d")) & (F.col("length") == F.col("l")), "left")
    named = named.select("page_id", "url", "html", F.when(F.col("page_id") < F.col("keeper"), F.col("keeper")).alias("keeper"), "keeper_url", "digest")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = batch.slice(k, 256).to_pylist()
                out = [x for r in rows for x in page_records(r["page_id"], r["url"], r["html"], r["keeper"], r["keeper_url"], r["digest"], date, segment_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    records = named.mapInArrow(work, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def unpacked(data: bytes, size: int = 1 << 18) -> Iterator[bytes | None]:
    """An archive's bytes in parts: those of its gzip members, one after another, or as they are. None stands where something is
    missing: a damaged member is given up and reading goes on at what looks like the next one."""
    if not data.startswith(GZIP[:2]):
        yield data
        return
    view, at = memoryview(data), 0
    while 0 <= at < len(data):
        began, member = at, zlib.decompressobj(wbits=31)
        try:
            while not member.eof and at < len(data):
                part = view[at : at + size]
                out = member.decompress(part)
                at += len(part) - len(member.unused_data)
                if out:
                    yield out
            whole = member.eof
        except zlib.error:
            whole = False
        if not whole:
            yield None
            at = data.find(GZIP, began + 1)


def hex_digest(stated: str | None) -> str | None:
    """A stated SHA-1, in hex or base32, as lower-case hex; None for other algorithms."""
    value = (stated or "").strip()
    kind, _, digest = value.rpartition(":")
    if kind.lower() not in ("sha1", ""):
        return None
    if re.fullmatch(r"[0-9a-fA-F]{40}", digest):
        return digest.lower()
    if re.fullmatch(r"[A-Za-z2-7]{32}", digest):
        return base64.b32decode(digest.upper()).hex()
    return None


def header_of(data: bytes) -> dict[str, str]:
    """A record's header fields by lower-case name; ValueError if it isn't one."""
    lines = data.decode().split("\r\n")
    if not lines[0].startswith("WARC/") or not all(":" in x for x in lines[1:]):
        raise ValueError("no record header")
    head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    if not head.get("content-length", "").isdigit():
        raise ValueError("record without length")
    return head


def parse_records(parts: Iterable[bytes | None]) -> Iterator[dict]:
    """The records of one archive file, by their lengths. What can't be read gives one row that says so, and reading goes on
    at the next place that looks like a record's begin: after two line ends, or at the begin of a part after a gap."""
    held, at, source, ended, gap = bytearray(), 0, iter(parts), False, False
    told = False  # whether a row has told of what stands before the next record

    def more() -> bool:
        """Takes in the next part; False at a gap or at the end."""
        nonlocal ended, gap
        part = END if ended else None if gap else next(source, END)
        ended, gap = part is END, part is None
        if ended or gap:
            return False
        held.extend(part)
        return True

    def drop(n: int) -> None:
        nonlocal at
        at += n
        del held[:n]

    while True:
        if len(held) < len(BEGIN) and more():
            continue
        problem, head = "data missing" if gap else "no record header", {}
        if held.startswith(BEGIN):
            end = held.find(CRLF + CRLF)
            while end < 0 and len(held) < HEADER and more():
                end = held.find(CRLF + CRLF)
            try:
                if end < 0:
                    raise ValueError("header cut short")
                head = header_of(bytes(held[:end]))
                body, stop = end + 4, end + 4 + int(head["content-length"])
                while len(held) < stop + 4 and more():
                    pass
                if len(held) < stop or held[stop : stop + 4] not in (CRLF + CRLF, CRLF, b""):
                    raise ValueError("record cut short" if len(held) < stop else "length differs")
            except ValueError as error:
                problem = str(error)
            else:
                yield fields_of(head, bytes(held[body:stop]))
                drop(min(stop + 4, len(held)))
                told = False
                continue
        if not told and (held or gap):
            known = {"record_id": head.get("warc-record-id"), "uri": head.get("warc-target-uri")}
            yield {k: v for k, v in known.items() if v} | {"problem": f"at byte {at}: {problem}"}
            told = True
        # On to the next begin of a record, in what is held or in what follows.
        found = held.find(CRLF + CRLF + BEGIN, 1)
        if found >= 0:
            drop(found + 4)
            told = False
        elif gap:  # after it a record begins with its part
            drop(len(held))
            gap, told = False, False
        elif ended:
            return
        else:
            drop(max(0, len(held) - len(BEGIN) - 4))
            more()


def fields_of(head: dict[str, str], block: bytes) -> dict:
    number = lambda k: int(head[k]) if head.get(k, "").lstrip("-").isdigit() else None
    return {
        "record_id": head.get("warc-record-id"), "origin": head.get("warc-segment-origin-id") or head.get("warc-record-id"), "segment": number("warc-segment-number"), "total": number("warc-segment-total-length"),
        "page_id": number("x-page-id"), "kind": head.get("warc-type"), "digest": hex_digest(head.get("warc-payload-digest")), "length": number("x-payload-length"), "refers": number("x-refers-to-page-id"), "uri": head.get("warc-target-uri"), "block": block,
    }


SCHEMA = pa.schema([("record_id", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()), ("kind", pa.string()), ("digest", pa.string()), ("length", pa.int64()), ("refers", pa.int64()), ("uri", pa.string()), ("block", pa.binary()), ("problem", pa.string())])
NAMES = ("page_id", "record_type", "refers_to", "target_uri", "payload", "payload_bytes", "payload_digest", "problem")
OUT = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("problem", pa.string())])
OUT_DDL = "page_id long, record_type string, refers_to long, target_uri string, payload binary, payload_bytes long, payload_digest string, problem string"


def finished(r: dict, block: bytes, problem: str | None = None) -> dict:
    """A page from its whole block: the payload's length and digest are computed, a revisit's are those it states."""
    out = dict.fromkeys(NAMES) | {"page_id": r.get("page_id"), "record_type": r.get("kind"), "refers_to": r.get("refers"), "target_uri": r.get("uri"), "problem": problem or r.get("problem")}
    if r.get("kind") == "revisit" and not out["problem"]:
        return out | {"payload_bytes": r["length"], "payload_digest": r["digest"]}
    if out["problem"]:
        return out
    try:
        payload = payload_of(block)
    except ValueError as error:
        return out | {"problem": str(error)}
    digest = hashlib.sha1(payload).hexdigest()
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest, "problem": None if digest == (r["digest"] or digest) else "digest differs"}


def assemble(segments: list[dict]) -> dict:
    """One page from its segments: numbers must run from 1 and lengths add up to the total that the last one states."""
    segments = sorted(segments, key=lambda s: s["segment"])
    block, problem = b"".join(s["block"] for s in segments), None
    if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)):
        problem = "segments missing or repeated"
    elif segments[-1]["total"] != len(block):
        problem = "total length differs"
    return finished(segments[0], block, problem)


def runs(batches: Iterator[pa.RecordBatch], wanted: Callable[[dict], bool], size: int = 4 << 20) -> Iterator[list[dict]]:
    """The wanted records of archive files, in lists of about so many bytes."""
    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            for r in parse_records(unpacked(content.as_py())):
                if r.get("kind") in ("response", "revisit", "continuation", None) and wanted(r):
                    rows.append(r)
                    held += len(r.get("block") or b"")
                    if held > size:
                        yield rows
                        rows, held = [], 0
            if rows:
                yield rows


def read_warc(spark: SparkSession, path: str, files: str = "part-*") -> DataFrame:
    """One row per response or revisit in the archives at path whose names match `files`: page_id and refers_to (null in
    archives of others, which target_uri tells apart), record_type, target_uri, payload (null for revisits), payload_bytes, payload_digest (hex SHA-1), problem (null if whole; else payload is null or differs).

    Whole records are finished where they are read; only segments are shuffled, by origin identifier. Other record types
    are skipped. Archives may be packed, a gzip member per record. A damaged member or record
    gives a row with a problem, and those behind it are read. A file is one value, below 2 GB packed, unpacked in parts. No
    files or no records: an empty result.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in runs(batches, lambda r: r.get("segment") is None):
            yield pa.RecordBatch.from_pylist([finished(x, x.get("block") or b"") for x in r], schema=OUT)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in runs(batches, lambda r: r.get("segment") is not None):
            yield pa.RecordBatch.from_pylist(r, schema=SCHEMA)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                yield pa.RecordBatch.from_pylist([assemble(r["s"]) for r in batch.slice(k, 64).to_pylist()], schema=OUT)

    # Two passes over the files cost less than keeping or shuffling every payload once more.
    files = spark.read.format("binaryFile").option("pathGlobFilter", files).load(path).select("content")
    segments = files.mapInArrow(parts, RECORD).select("origin", F.struct("segment", "total", "page_id", "kind", "digest", "length", "refers", "uri", "problem", "block").alias("s"))
    joined = segments.groupBy("origin").agg(F.collect_list("s").alias("s")).select("s").mapInArrow(join, OUT_DDL)
    return files.mapInArrow(whole, OUT_DDL).unionByName(joined)


def unmatched_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, refers_to, problem) of read revisits that name a page which isn't among the responses or has another payload.

    Revisits that name no page, as in archives of others, aren't judged. Only ids, lengths and digests are shuffled.
    """
    ours = pages.where("record_type = 'revisit' AND refers_to IS NOT NULL").select("page_id", "refers_to", F.col("payload_bytes").alias("length"), F.col("payload_digest").alias("digest"))
    there = pages.where("record_type = 'response' AND problem IS NULL").groupBy(F.col("page_id").alias("there")).agg(F.min(F.struct("payload_bytes", "payload_digest")).alias("has"))
    joined = ours.join(there, F.col("refers_to") == F.col("there"), "left")
    problem = F.when(F.col("there").isNull(), "response missing").when(F.col("has") != F.struct("length", "digest"), "response differs")
    return joined.select("page_id", "refers_to", problem.alias("problem")).where("problem IS NOT NULL")
