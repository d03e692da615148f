"""Operator 4: conversion of legacy ARC archives to WARC records.

An archive starts with a version block that names its version (1 or 2) and the fields of its record
lines; each record is such a line and as many bytes as its last field declares. For each record the
WARC identifier, timestamp, type and digests are made from what the ARC holds, the same on each run.
One map stage over the archives. gzip members are inflated one after the other, so that what is held at a
time is an archive and one member (archives that are one single member are inflated whole). A damaged
member gives an error row and reading goes on with the next one.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator, Sequence
from datetime import datetime
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.chunks import by_batches
from tessera.plans.columns import pick
from tessera.sources.tables import table

FIELDS = {
    b"1": [b"URL", b"IP-address", b"Archive-date", b"Content-type", b"Archive-length"],
    b"2": [b"URL", b"IP-address", b"Archive-date", b"Content-type", b"Result-code", b"Checksum", b"Location", b"Offset", b"Filename", b"Archive-length"],
}
COLUMNS = ("record_id", "warc_type", "warc_date", "target_uri", "ip_address", "content_type", "block_digest", "payload_digest", "truncated", "error")
_OUT = "archive string, offset bigint, " + ", ".join(f"{c} string" for c in COLUMNS) + ", block_length bigint"


_MAGIC = b"\x1f\x8b\x08"
#: Compressed bytes given to the inflater at once.
_STEP = 1 << 16


def _members(raw: bytes) -> Iterator[tuple[int, bytes | None]]:
    """(place, bytes) of each gzip member, None for a damaged one; after it the next place that looks like
    the head of a member is tried. Bytes between members are left out."""
    at = 0
    while at >= 0:
        d, end, out = zlib.decompressobj(31), at, []
        try:
            while not d.eof and end < len(raw):
                out.append(d.decompress(raw[end : end + _STEP]))
                end = min(end + _STEP, len(raw))
            good = d.eof
        except zlib.error:
            good = False
        if good:
            yield at, b"".join(out)
            at = raw.find(_MAGIC, end - len(d.unused_data))
        else:
            yield at, None
            at = raw.find(_MAGIC, at + 1)


def warc_date(stamp: bytes) -> str | None:
    """The ISO form of an ARC date of 8, 12 or 14 digits; None for another or impossible one."""
    if not stamp.isdigit() or len(stamp) not in (8, 12, 14):
        return None
    try:
        return datetime.strptime(stamp.decode().ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return None


def digest(data: bytes | memoryview) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record_id(archive: str, offset: int, url: str, stamp: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{archive} {offset} {url} {stamp}'.encode(), usedforsecurity=False).digest())}>"


def payload(block: bytes) -> bytes:
    """What follows the header of an HTTP response."""
    ends = [(i, n) for i, n in ((block.find(b"\r\n\r\n"), 4), (block.find(b"\n\n"), 2)) if i >= 0]
    if not ends:
        return b""
    i, n = min(ends)
    return block[i + n :]


def _empty(archive: str, offset: int, error: str) -> dict:
    return dict.fromkeys(COLUMNS) | {"archive": archive, "offset": offset, "block_length": None, "error": error}


def _record_length(line: bytes) -> int | None:
    last = line.rsplit(b" ", 1)[-1]
    return int(last) if last.isdigit() else None


def records(archive: str, raw: bytes | None, with_block: bool = False) -> Iterator[dict]:
    """The WARC records of one archive. What can't be read gives a row with ``error``: a damaged gzip member,
    after which reading goes on with the next one, or a damaged line, which ends plain archives but only
    the member it is in of compressed ones. Offsets count the inflated bytes of whole members."""
    if not raw:
        yield _empty(archive, 0, "empty archive")
        return
    fields, base, held = None, 0, b""
    several = raw[:2] == _MAGIC[:2]
    for _, part in _members(raw) if several else [(0, raw)]:
        if part is None:
            if held:
                fields, rows, _ = _parse(archive, held, base, fields, with_block, True)
                yield from rows
                base, held = base + len(held), b""
            yield _empty(archive, base, "damaged gzip member")
            fields = fields or ()  # if that was the version block, the number of fields tells the version
            continue
        held += part
        fields, rows, used = _parse(archive, held, base, fields, with_block, not several)
        yield from rows
        base, held = base + used, held[used:]
    if held:
        yield from _parse(archive, held, base, fields, with_block, True)[1]
    elif not base and fields is None and not several:
        yield _empty(archive, 0, "empty archive")


def _parse(archive: str, data: bytes, base: int, fields: Sequence[bytes] | None, with_block: bool, last: bool) -> tuple[Sequence[bytes] | None, list[dict], int]:
    """(fields of the record lines, records, bytes read) of ``data``, which begins ``base`` bytes into the
    archive. Unless these are the ``last`` bytes, a record that they don't hold whole is left for later."""
    at, out = 0, []

    def failed(head: int, error: str) -> tuple[Sequence[bytes] | None, list[dict], int]:
        return fields, [*out, _empty(archive, base + head, error)], len(data)

    while at < len(data):
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            break
        head, end = at, data.find(b"\n", at)
        if end < 0:
            return failed(head, "record line without end") if last else (fields, out, head)
        line = data[at:end].rstrip(b"\r")
        if fields is None:
            if not line.startswith(b"filedesc:"):
                return failed(head, "no version block")
            length = _record_length(line)
            if not last and length is not None and end + 1 + length > len(data):
                return fields, out, head
            version = data[end + 1 : end + 2]
            if version not in FIELDS:
                return failed(head, "unknown version")
            first = data.find(b"\n", end + 1)
            named = data[first + 1 : data.find(b"\n", first + 1)].split() if first >= 0 else []
            fields = named if named and named[-1] == b"Archive-length" and set(named) <= set(FIELDS[version]) else FIELDS[version]
            own = FIELDS[b"1"] if len(line.split(b" ")) == len(FIELDS[b"1"]) else fields
        else:
            own = fields or FIELDS[b"2" if len(line.split(b" ")) >= len(FIELDS[b"2"]) else b"1"]
        parts = line.rsplit(b" ", len(own) - 1)
        if len(parts) != len(own) or not parts[-1].isdigit():
            return failed(head, "bad record line")
        row = dict(zip(own, parts, strict=True))
        length = int(row[b"Archive-length"])
        if not last and end + 1 + length > len(data):
            return fields, out, head
        block = data[end + 1 : end + 1 + length]
        at = end + 1 + length
        url, mime = row[b"URL"].decode("utf-8", "replace"), row.get(b"Content-type", b"").decode("latin-1")
        scheme = url.split(":", 1)[0].lower()
        if scheme == "filedesc":
            type_, content, body = "warcinfo", "application/warc-fields", block
        elif scheme in ("http", "https") and block.startswith(b"HTTP/"):
            type_, content, body = "response", "application/http; msgtype=response", payload(block)
        elif scheme == "dns":
            type_, content, body = "response", "text/dns", block
        else:
            type_, content, body = "resource", mime or "application/octet-stream", block
        date = warc_date(row.get(b"Archive-date", b""))
        ip = row.get(b"IP-address", b"").decode("latin-1")
        out.append({
            "archive": archive, "offset": base + head, "record_id": record_id(archive, base + head, url, date or ""), "warc_type": type_, "warc_date": date, "target_uri": None if type_ == "warcinfo" else url, "ip_address": None if ip in ("", "-", "0.0.0.0") else ip,
            "content_type": content, "block_digest": digest(block), "payload_digest": digest(body) if type_ != "warcinfo" else None, "truncated": "length" if len(block) < length else None, "error": None if date else "bad date", "block_length": len(block),
        } | ({"block": block} if with_block else {}))
    return fields, out, len(data)


def warc_bytes(row: dict) -> bytes:
    """A record of ``records(..., with_block=True)`` as WARC 1.1."""
    named = (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "warc_date"), ("WARC-Target-URI", "target_uri"), ("WARC-IP-Address", "ip_address"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Truncated", "truncated"), ("Content-Type", "content_type"), ("Content-Length", "block_length"))
    head = "".join(f"{k}: {row[c]}\r\n" for k, c in named if row[c] is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + row["block"] + b"\r\n\r\n"


def convert(archives: DataFrame, archive: str = "archive", content: str = "content") -> DataFrame:
    """One row for each record of each archive: the WARC header's fields.

    A null or empty archive, one without a version block, a damaged record line and a missing line end
    give one row with ``error`` in place of the rest of the archive (of the gzip member, if it has
    several); so does each damaged gzip member, and the records of the others follow; a record cut short
    is marked truncated; an impossible date is null with ``error``. Null archive names count as empty
    ones, repeated archives are converted each, other columns, whatever their names, not looked at, and
    an empty table gives an empty one."""
    own = pick(archives, archive=archive, content=content)

    def run(batches):
        names = ["archive", "offset", *COLUMNS, "block_length"]
        kinds = [pa.string(), pa.int64(), *[pa.string()] * len(COLUMNS), pa.int64()]
        found = (r for b in batches for a, c in zip(b.column(0), b.column(1), strict=True) for r in records(a.as_py() or "", c.as_py()))
        while rows := list(islice(found, 1000)):
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return by_batches(own, run, _OUT)


_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"


def to_archives(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(archive, content): each page as an ARC file, of version 1 for even and 2 for odd ids, as the
    given tables hold none."""
    own = pick(pages, id=id, url=url, html=html)
    name = F.concat(F.lit("page-"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(".arc"))
    two = F.coalesce(F.col("id") % 2 != 0, F.lit(False))
    stamp = F.date_format(F.timestamp_seconds(F.lit(978307200) + F.coalesce(F.col("id"), F.lit(0)) * 61), "yyyyMMddHHmmss")
    block = F.concat(F.lit(_HTTP), F.coalesce("html", F.lit("")))
    fields = {v: " ".join(x.decode() for x in FIELDS[v.encode()]) for v in ("1", "2")}
    opening = {v: f"{v} 0 Tessera\n{fields[v]}\n" for v in fields}
    def line(v: str):
        head = F.concat(F.lit("filedesc://"), name, F.lit(" 0.0.0.0 "), stamp, F.lit(f" text/plain {len(opening[v])}\n{opening[v]}\n"))
        extra = " 200 - - 0 - " if v == "2" else " "
        return F.concat(head, F.coalesce(F.regexp_replace("url", r"[ \n]", "%20"), F.lit("unknown:")), F.lit(" 192.0.2.1 "), stamp, F.lit(" text/html" + extra), F.octet_length(block).cast("string"), F.lit("\n"), block, F.lit("\n"))
    return own.select(name.alias("archive"), F.encode(F.when(two, line("2")).otherwise(line("1")), "UTF-8").alias("content"))


def op4_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The WARC fields of all records of the pages' archives."""
    return convert(to_archives(table(spark, sf_dir, "pages")))


_B32 = "'sha1:' || list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr({h}, 1 + 5 * (i // 4)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int, 1)), 'string_agg', '')"
_UUID = "'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21) || '>'"


def _sql() -> str:
    named = {v: " ".join(x.decode() for x in FIELDS[v.encode()]) for v in ("1", "2")}
    opening = {v: f"{v} 0 Tessera\n{named[v]}\n" for v in named}
    open_ = " ".join(f"when v = '{v}' then '{o}'" for v, o in opening.items()).replace("\n", "' || chr(10) || '")
    http = _HTTP.replace("\r\n", "' || chr(13) || chr(10) || '")
    b32 = lambda x: _B32.format(h=f"sha1({x})")
    uid = lambda x: _UUID.format(h=f"md5({x})")
    common = "null::varchar as truncated, null::varchar as error"
    return f"""
        with p as (select 'page-' || page_id || '.arc' as archive, case when page_id % 2 <> 0 then '2' else '1' end as v, url, html,
            make_timestamp((978307200 + page_id * 61) * 1000000) as ts from pages),
        q as (select *, strftime(ts, '%Y%m%d%H%M%S') as stamp, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso, case {open_} end as opening, '{http}' || html as block from p),
        r as (select *, 'filedesc://' || archive || ' 0.0.0.0 ' || stamp || ' text/plain ' || strlen(opening) || chr(10) || opening || chr(10) as head from q)
        select archive, 0::bigint as "offset", {uid("archive || ' 0 filedesc://' || archive || ' ' || iso")} as record_id, 'warcinfo' as warc_type, iso as warc_date, null::varchar as target_uri,
            null::varchar as ip_address, 'application/warc-fields' as content_type, {b32("opening")} as block_digest, null::varchar as payload_digest, {common}, strlen(opening)::bigint as block_length from r
        union all
        select archive, strlen(head)::bigint, {uid("archive || ' ' || strlen(head) || ' ' || url || ' ' || iso")}, 'response', iso, url, '192.0.2.1', 'application/http; msgtype=response',
            {b32("block")}, {b32("html")}, null, null, strlen(block)::bigint from r"""


SQL = _sql()
