"""Legacy archives (ARC 1 and 2) to WARC 1.1.

``parse_arc`` reads an archive by its own declarations: the version block
names the fields of every header line, and each line declares the length of
what follows. ``convert`` turns the captures into WARC records: identifiers
and digests are computed, 14-digit dates become ISO times, HTTP captures become
``response`` records, and captures whose payload was seen elsewhere become
``revisit`` records that refer to the one kept.

Record identifiers are version-8 UUIDs made of the source's key and the
payload digest, so a rerun writes the same identifiers and a reader gets the
key back.

WARC files are written with Spark's text sink: a record ends with CR LF CR LF,
which is the sink's line separator, and all content is UTF-8. They are read
with the binary-file source, parsed by declared length, and every payload is
checked against its digest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlstrata.llm.common import scratch, slices, written

#: Field names of the header lines, by version (fixed values of the format).
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EPOCH = datetime(2001, 1, 1, tzinfo=timezone.utc)

# ---------------------------------------------------------------- ARC


def _clean_url(url: str | None) -> str:
    """A header field: no blanks or control characters; "-" if there is none."""
    out = "".join(c if c > " " and c != "\x7f" and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    return out or "-"


def http_block(body: bytes) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body


def build_arc(captures: list[tuple[str | None, str, bytes]], version: int) -> bytes:
    """An archive of (url, 14-digit date, block) captures."""
    about = f"{version} 0 sqlstrata\n{ARC_FIELDS[version]}\n\n".encode()
    mid = "" if version == 1 else " 200 - - 0 capture.arc"
    parts = [f"filedesc://capture.arc 0.0.0.0 20010101000000 text/plain{mid} {len(about)}\n".encode(), about, b"\n"]
    for url, date, block in captures:
        parts += [f"{_clean_url(url)} 0.0.0.0 {date} text/html{mid} {len(block)}\n".encode(), block, b"\n"]
    return b"".join(parts)


def parse_arc(data: bytes) -> Iterator[dict]:
    """Captures of an archive: its fields by name, and ``block``. The first
    record must be the version block; a length beyond the end, a line with
    another number of fields or an unknown version raises ``ValueError``."""
    at, names = 0, None
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"header line without end at byte {at}")
        line = data[at:end].decode("utf-8").rstrip("\r").split(" ")
        try:
            size = int(line[-1])
        except ValueError as e:
            raise ValueError(f"no length in the header line at byte {at}") from e
        block = data[end + 1:end + 1 + size]
        if size < 0 or len(block) != size:
            raise ValueError(f"the record at byte {at} is cut")
        at = end + 1 + size
        if names is None:
            about = block.decode("utf-8").split("\n")
            version = about[0].split(" ")[0]
            if not line[0].startswith("filedesc:") or version not in ("1", "2") or len(about) < 2:
                raise ValueError("no version block of version 1 or 2")
            names = about[1].strip().split(" ")
            if names != ARC_FIELDS[int(version)].split(" "):
                raise ValueError(f"fields do not fit version {version}")
            continue
        if len(line) != len(names):
            raise ValueError(f"{len(line)} fields instead of {len(names)}: {line[0]}")
        yield {**dict(zip(names, line)), "block": block}


# ---------------------------------------------------------------- records


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | None, payload_digest: str) -> str:
    """UUID of version 8: 64 bits of the key, one bit for a missing key, 57
    bits of the digest."""
    top = int.from_bytes(base64.b32decode(payload_digest)[:8], "big") >> 7
    bits = ((key or 0) & (1 << 64) - 1) << 58 | (key is None) << 57 | top
    a, b, c = bits >> 74, bits >> 62 & 0xFFF, bits & (1 << 62) - 1
    return f"urn:uuid:{uuid.UUID(int=a << 80 | 8 << 76 | b << 64 | 2 << 62 | c)}"


def key_of(rid: str) -> int | None:
    n = uuid.UUID(rid.rpartition(":")[2]).int
    bits = n >> 80 << 74 | (n >> 64 & 0xFFF) << 62 | n & (1 << 62) - 1
    key = bits >> 58
    return None if bits >> 57 & 1 else key - (1 << 64 if key >> 63 else 0)


def payload_start(block: bytes) -> int:
    """Where the payload of an HTTP block begins (0: no HTTP head)."""
    if not block.startswith(b"HTTP/"):
        return 0
    cut = block.find(b"\r\n\r\n")
    return len(block) if cut < 0 else cut + 4


def warc_record(key: int | None, capture: dict, refers: int | None) -> str:
    """The record's text without its closing CR LF CR LF. ``refers``: key of
    the record that keeps the payload, if this one does not."""
    block, start = capture["block"], payload_start(capture["block"])
    d = digest(block[start:])
    when = datetime.strptime(capture["Archive-date"], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    kept = block if refers is None else block[:start]
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers is not None else 'response' if start else 'resource'}",
            f"WARC-Record-ID: <{record_id(key, d)}>", f"WARC-Date: {when}"]
    if capture["URL"] != "-":
        head.append(f"WARC-Target-URI: {capture['URL']}")
    if capture["IP-address"] != "0.0.0.0":
        head.append(f"WARC-IP-Address: {capture['IP-address']}")
    if refers is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers, d)}>"]
    head += [f"WARC-Payload-Digest: sha1:{d}", f"WARC-Block-Digest: sha1:{digest(kept)}",
             f"Content-Type: {'application/http; msgtype=response' if start else capture['Content-type']}",
             f"Content-Length: {len(kept)}"]
    return "\r\n".join(head) + "\r\n\r\n" + kept.decode("utf-8")


def parse_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(fields, block) of every record; gzip is recognised, in one or many
    members."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data:
            z = zlib.decompressobj(31)
            parts.append(z.decompress(data) + z.flush())
            data = z.unused_data
        data = b"".join(parts)
    at = 0
    while at < len(data):
        cut = data.find(b"\r\n\r\n", at)
        lines = data[at:cut].decode("utf-8").split("\r\n")
        if cut < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size, at = int(fields["content-length"]), cut + 4
        block = data[at:at + size]
        if len(block) != size or data[at + size:at + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record before byte {at} is cut")
        at += size + 4
        yield fields, block


# ---------------------------------------------------------------- Spark


def pages_to_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(archive, keys): archives of a few MB, versions 1 and 2 in turn, with
    the pages' ids in the order of their captures. A null html is an empty
    payload, a null url "-", a null id stays null."""
    schema = pa.schema([("archive", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for b in slices(batch, "html"):
                keys = b.column(0).to_pylist()
                caps = []
                for key, url, html in zip(keys, b.column(1).to_pylist(), b.column(2).to_pylist()):
                    when = _EPOCH + timedelta(seconds=(key or 0) % 500_000_000)
                    caps.append((url, when.strftime("%Y%m%d%H%M%S"), http_block((html or "").encode())))
                yield pa.RecordBatch.from_arrays([pa.array([build_arc(caps, 1 + n % 2)], pa.binary()),
                                                  pa.array([keys], pa.list_(pa.int64()))], schema=schema)
                n += 1

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html")).mapInArrow(run, "archive binary, keys array<long>")


def arc_digests(archives: DataFrame) -> DataFrame:
    """(key, digest, bytes) of every capture's payload."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, keys in zip(b.column(0), b.column(1)):
                found = [(digest(p), len(p)) for c in parse_arc(data.as_py()) for p in [c["block"][payload_start(c["block"]):]]]
                yield pa.RecordBatch.from_arrays([keys.values, pa.array([x[0] for x in found], pa.string()),
                                                  pa.array([x[1] for x in found], pa.int64())], names=["key", "digest", "bytes"])

    return archives.mapInArrow(run, "key long, digest string, bytes long")


def arc_captures(archives: DataFrame) -> DataFrame:
    """(key, digest, url, ip, date, ctype, block) of every capture."""
    names = ["key", "digest", "url", "ip", "date", "ctype", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, keys in zip(b.column(0), b.column(1)):
                caps = list(parse_arc(data.as_py()))
                cols = [keys.values, pa.array([digest(c["block"][payload_start(c["block"]):]) for c in caps], pa.string())]
                cols += [pa.array([c[k] for c in caps], pa.string()) for k in ("URL", "IP-address", "Archive-date", "Content-type")]
                cols.append(pa.array([c["block"] for c in caps], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return archives.mapInArrow(run, "key long, digest string, url string, ip string, date string, ctype string, block binary")


def write_warc(archives: DataFrame, out: str, min_bytes: int = 0) -> None:
    """Convert all captures and write them to ``out`` as gzipped WARC files.

    Of captures with equal payloads of ``min_bytes`` or more, the one with the
    largest key keeps the payload. Only payloads that occur again are listed
    (a written table, so Spark knows its size before it chooses the join).
    Captures that repeat the largest key all keep theirs; a null key never
    does when there is another.
    """
    again = (arc_digests(archives).filter(F.col("bytes") >= min_bytes).groupBy("digest")
             .agg(F.max("key").alias("keeper"), F.count("*").alias("n")).filter("n > 1 and keeper is not null"))
    again = written(again.select(F.col("digest").alias("_d"), "keeper"), "payloads")
    caps = arc_captures(archives)
    caps = caps.join(again, F.col("digest") == F.col("_d"), "left").drop("_d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "block"):
                lines = []
                for key, _, url, ip, date, ctype, block, keeper in zip(*(c.to_pylist() for c in b.columns)):
                    cap = {"URL": url, "IP-address": ip, "Archive-date": date, "Content-type": ctype, "block": block}
                    lines.append(warc_record(key, cap, None if keeper is None or keeper == key else keeper))
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    caps.mapInArrow(run, "value string").write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(out)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: key, record id, type, uri, date, digest and length
    of the full payload, and the key it refers to. A payload that does not fit
    its digest raises ``ValueError``."""
    names = ["key", "record_id", "record_type", "uri", "date", "payload_digest", "payload_bytes", "refers_to"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                rows = []
                for f, block in parse_warc(data.as_py()):
                    start, d = payload_start(block), f["warc-payload-digest"].removeprefix("sha1:")
                    rid, to = f["warc-record-id"].strip("<>"), f.get("warc-refers-to")
                    if f["warc-type"] == "revisit":
                        head = block[:start].decode().lower()
                        size = int(head.partition("\r\ncontent-length:")[2].partition("\r\n")[0])
                    else:
                        size = len(block) - start
                        if digest(block[start:]) != d:
                            raise ValueError(f"payload of {rid} does not fit its digest")
                    rows.append((key_of(rid), rid, f["warc-type"], f.get("warc-target-uri"), f["warc-date"], d, size,
                                 key_of(to.strip("<>")) if to else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 8, types)], names=names)

    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
            .mapInArrow(run, "key long, record_id string, record_type string, uri string, date string, "
                             "payload_digest string, payload_bytes long, refers_to long"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "warc")
    write_warc(pages_to_arc(spark.read.parquet(f"{sf_dir}/pages.parquet")), out, min_bytes=0)
    got = read_warc(spark, out)
    return got.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
