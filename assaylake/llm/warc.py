"""WARC derivatives: from each response a metadata record and a plain-text conversion record.

Both refer to the response by its identifier and repeat its target and date; the metadata record holds the response's own
WARC and HTTP headers, its digests as declared and as computed, and its title, links and sizes as JSON; the conversion holds the
page's visible text, its transfer and content encodings undone; a payload in an encoding that is not known here gives the empty text, and the
metadata says so. Identifiers of derivatives follow from the response's identifier, so that a repeated attempt makes
the same records. Each response is handled alone, in batches; there is no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .memory import lean

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
DERIVED = uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")
TYPES = {"metadata": "application/json", "conversion": "text/plain"}
RECORDS = pa.schema(
    [("page_id", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("block_digest", pa.string()), ("payload_digest", pa.string()), ("content_length", pa.int64()), ("block", pa.string()), ("error", pa.string())]
)
RECORDS_SQL = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, block_digest string, payload_digest string, content_length long, block string, error string"

PART = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)[^>]*>|<[!?][^>]*>", re.DOTALL | re.IGNORECASE)
INLINE = frozenset("a abbr b bdi bdo cite code del dfn em font i ins kbd mark q s samp small span strong sub sup tt u var wbr".split())
SPACE = re.compile(r"[ \t\r\f\v\xa0]+")
LINES = re.compile(r" ?\n[ \n]*")
UNENDED = re.compile(r"<[a-zA-Z/!?]")
#: Elements that link, and the attributes that say where to.
LINKING = frozenset("a link img script iframe form".split())
TARGET = re.compile(r"""\s(?:href|src|action)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(DERIVED, chr(31).join(names))}>"


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record; Content-Length is added. Line ends in values become spaces."""
    lines = [VERSION, *(f"{k}: {' '.join(v.split())}" for k, v in headers if k.lower() != "content-length"), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _head(raw: bytes) -> list[tuple[str, str]]:
    """Header fields in order; a line that begins with white space goes on with the one before."""
    fields: list[tuple[str, str]] = []
    for line in raw.decode("utf-8", "replace").split("\n"):
        line = line.rstrip("\r")
        if line[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        elif ":" in line:
            k, _, v = line.partition(":")
            fields.append((k.strip(), v.strip()))
    return fields


def get(fields: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in fields if k.lower() == name.lower()), None)


def _members(raw: bytes) -> tuple[bytes, str | None]:
    """What the whole gzip members hold, up to the first that is damaged or breaks off, and what is wrong with that."""
    out: list[bytes] = []
    while raw.rstrip(b"\0"):
        member = zlib.decompressobj(31)
        try:
            got = member.decompress(raw)
        except zlib.error as e:
            return b"".join(out), f"gzip member {len(out)}: {e}"
        if not member.eof:
            return b"".join(out), f"gzip member {len(out)} breaks off"
        out.append(got)
        raw = member.unused_data
    return b"".join(out), None


def read_records(raw: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Header fields and block of each record of a file's bytes, plain or of gzip members. A record that breaks off, or a damaged member, raises ValueError after the records before it."""
    damage = None
    if raw[:2] == b"\x1f\x8b":
        raw, damage = _members(raw)
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        if not raw.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at {at}")
        fields = _head(raw[raw.find(b"\n", at) + 1 : end])
        size = get(fields, "Content-Length")
        if size is None or not size.isdigit() or end + 4 + int(size) > len(raw):
            raise ValueError(f"the record at {at} breaks off")
        yield fields, raw[end + 4 : end + 4 + int(size)]
        at = end + 4 + int(size)
        while raw.startswith(b"\r\n", at):
            at += 2
    if damage:
        raise ValueError(damage)


def response_record(page_id: int | None, url: str | None, page: str | None, date: str = DATE) -> bytes:
    """A page as a response record, as a crawler would have stored it."""
    payload = (page or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload
    fields = [
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(page_id), url or "", digest(payload))), ("WARC-Date", date), ("WARC-Target-URI", url or ""),
        ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http; msgtype=response"),
    ]
    return write_record(fields, block)


def read_page(page: str) -> tuple[str, str | None, list[tuple[str, str]]]:
    """Lines of a page's text without markup, scripts and styles, without blank ones; its first title that ends; and of each element
    that links (LINKING) the first target. All in one walk over tags, so scripts and comments hold no links. A tag that the page's
    end cuts off is no text.
    """
    last = page.rfind(">") + 1
    if cut := UNENDED.search(page, last):
        page = page[: cut.start()]  # from here on every tag has an end, so that none is looked for twice
    links: list[tuple[str, str]] = []
    title: list[str] = []
    begun = -1

    def tag(m: re.Match) -> str:
        nonlocal begun
        name = (m[1] or m[3] or "").lower()
        if name in LINKING and not m[2]:
            if found := TARGET.search(page, m.start(), page.find(">", m.start()) + 1 if m[1] else m.end()):
                links.append((name, html.unescape(found[1].strip("\"'"))))
        elif name == "title" and not title:
            if m[2] and begun >= 0:
                title.append(page[begun : m.start()])
            elif not m[2] and begun < 0:
                begun = m.end()
        return "" if m[3] and name in INLINE else "\n"

    body = PART.sub(tag, page.replace("\n", " "))
    return LINES.sub("\n", SPACE.sub(" ", html.unescape(body))).strip(), " ".join(html.unescape(title[0]).split()) if title else None, links


def visible_text(page: str) -> str:
    return read_page(page)[0]


def _decoded(http: list[tuple[str, str]], payload: bytes) -> str:
    m = re.search(r"charset=[\"']?([\w.:-]+)", get(http, "Content-Type") or "", re.IGNORECASE)
    try:
        return payload.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def _chunks(raw: bytes) -> bytes:
    """What a body in chunks holds, as far as it is whole."""
    out, at = [], 0
    while (end := raw.find(b"\n", at)) >= 0:
        size = raw[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size) or not int(size, 16):
            break
        out.append(raw[end + 1 : end + 1 + int(size, 16)])
        at = end + 1 + int(size, 16)
        at += 2 if raw[at : at + 2] == b"\r\n" else 1
    return b"".join(out)


def unpacked(http: list[tuple[str, str]], payload: bytes) -> tuple[bytes, str | None]:
    """A payload without its transfer and content encodings, and the encoding that can't be undone, if any; that far it is unpacked."""
    if "chunked" in (get(http, "Transfer-Encoding") or "").lower() and re.match(rb"[0-9A-Fa-f]{1,15}[ \t]*(;[^\n]*)?\r?\n", payload):
        payload = _chunks(payload)
    for name in reversed([x.strip().lower() for x in (get(http, "Content-Encoding") or "").split(",") if x.strip()]):
        if name == "identity":
            continue
        if name not in ("gzip", "x-gzip", "deflate"):
            return payload, name
        raw = name == "deflate" and (payload[:1] or b"x")[0] & 15 != 8
        member = zlib.decompressobj(31 if "gzip" in name else -15 if raw else 15)
        try:
            payload = member.decompress(payload)
        except zlib.error:
            return payload, name
    return payload, None


def derive(fields: list[tuple[str, str]], block: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """The metadata and the conversion record of a response; none for records of other types."""
    if (get(fields, "WARC-Type") or "").lower() != "response":
        return []
    status, _, rest = block.partition(b"\n")
    if not status.startswith(b"HTTP/"):
        http, payload, status = [], block, b""
    else:
        end = re.search(rb"\r?\n\r?\n", block)
        http, payload = (_head(block[len(status) + 1 : end.start()]), block[end.end() :]) if end else (_head(rest), b"")
    source, uri, date = get(fields, "WARC-Record-ID") or "", get(fields, "WARC-Target-URI") or "", get(fields, "WARC-Date") or ""
    body, packed = unpacked(http, payload)
    page = "" if packed else _decoded(http, body)
    text, title, found_links = read_page(page)
    links = [{"tag": tag, "url": _absolute(uri, url)} for tag, url in found_links]
    found = {"block": digest(block), "payload": digest(payload)}
    about = {
        "warc": [list(x) for x in fields], "status": status.decode("latin-1").strip(), "http": [list(x) for x in http],
        "digests": {"computed": found, "matches": {k: _same(get(fields, f"WARC-{k.title()}-Digest"), v) for k, v in found.items()}},
        "payload_bytes": len(payload), "title": title, "links": links,
    } | ({"encoding_unknown": packed} if packed else {})
    out = []
    for kind, body in (("metadata", json.dumps(about, ensure_ascii=False)), ("conversion", text)):
        raw = body.encode("utf-8", "replace")
        own = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, source)), ("WARC-Refers-To", source), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Block-Digest", digest(raw)), ("WARC-Payload-Digest", get(fields, "WARC-Payload-Digest") or found["payload"]), ("Content-Type", TYPES[kind])]
        out.append((own, raw))
    return out


def _absolute(base: str, url: str) -> str:
    try:
        return urljoin(base, url)
    except ValueError:
        return url


def _same(declared: str | None, computed: str) -> bool | None:
    """None where nothing is declared or another algorithm is."""
    if not declared or declared.split(":")[0].lower() != computed.split(":")[0]:
        return None
    return declared.split(":", 1)[1].upper() == computed.split(":", 1)[1]


def _derivatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, len(whole), 200):
            batch, out = whole.slice(k, 200), []
            for page_id, record in zip(batch.column("page_id").to_pylist(), batch.column("record").to_pylist(), strict=True):
                try:
                    for fields, block in read_records(record or b""):
                        for own, raw in derive(fields, block):
                            out.append((page_id, get(own, "WARC-Type"), get(own, "WARC-Record-ID"), get(own, "WARC-Refers-To"), get(own, "WARC-Target-URI"), get(own, "WARC-Date"), get(own, "WARC-Block-Digest"), get(own, "WARC-Payload-Digest"), len(raw), raw.decode("utf-8", "replace"), None))
                except ValueError as e:
                    out.append((page_id, *[None] * 9, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out) if out else [()] * len(RECORDS), RECORDS, strict=True)], schema=RECORDS)


def derivatives(records: DataFrame) -> DataFrame:
    """The derivative records of rows (page_id, record: one or more WARC records, plain or gzip; others unread).

    Two rows per response; none for other records, nulls and empty bytes; one row with `error` where bytes are no WARC or break off,
    after those of the records before. Rows that repeat give the same derivatives again.
    """
    return records.select(F.col("page_id").cast("long").alias("page_id"), F.col("record").cast("binary").alias("record")).mapInArrow(lean(_derivatives), RECORDS_SQL)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, len(whole), 200):
            rows = whole.slice(k, 200).to_pylist()
            raw = [response_record(r["page_id"], r["url"], r["html"]) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["page_id"] for r in rows], pa.int64()), pa.array(raw, pa.binary())], names=["page_id", "record"])


def responses(pages: DataFrame) -> DataFrame:
    """page_id, record: each row of pages (page_id, url, html) as a WARC response record; nulls are empty."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(lean(_store), "page_id long, record binary")


def op8_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))
