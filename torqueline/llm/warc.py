"""WARC derivatives: metadata and plain-text conversion records for captured responses.

A record is a row of ``headers`` (map of WARC fields) and ``block`` (bytes).  ``derive`` turns each response
into a metadata record (JSON: the source's WARC and HTTP headers, title, links) and, if its content is
text, a conversion record (the text of the page).  Both name the response in WARC-Refers-To, keep its target and date,
carry its payload digest as WARC-Source-Payload-Digest, and have block digests of their own.  Record ids
are version 5 UUIDs of the response's id and the record's type, so a second run gives the same records.

``write_records`` writes WARC files through the text sink, since these blocks are UTF-8; ``read_records`` reads files
with or without gzip by their Content-Length, a file at a time, so files should be kept to about 1 GB as is usual.

Defined results: records that are not responses give no derivatives.  A null or empty block has no HTTP head, no
links and an empty text.  Missing headers stay missing.  Page text is read whole in one linear pass: an unclosed
comment, script or style runs to the end of the page, and bytes outside the charset become U+FFFD.
Chunked framing, gzip and deflate are taken off, as far as they are whole; a charset that does not exist or cannot read
the body is read as UTF-8.  Repeated rows give repeated records with equal ids.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import sys
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from torqueline.llm.base import with_text_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+)>""")
LINK = re.compile(r"""(?:^|\s)(href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
CHARSET = re.compile(r"charset=[\"']?([\w.:-]+)", re.I)
BLANKS = re.compile(r"[^\S\n]+")
LINES = re.compile(r" ?\n\s*")
# fixed values: elements that begin a line, and elements whose content is no text
LINE_TAGS = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hr html li main nav ol option p pre section select table tbody td tfoot th thead title tr ul".split())
SILENT_TAGS = frozenset(("script", "style", "noscript", "template"))


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_text(page: str) -> tuple[str, str, list[str]]:
    """(text, title, links) of an HTML page."""
    out: list[str] = []
    links: list[str] = []
    title, in_title, at = [], False, 0
    lower = None
    while (open_ := page.find("<", at)) >= 0:
        out.append(page[at:open_])
        if in_title:
            title.append(page[at:open_])
        if page.startswith("<!--", open_):
            end = page.find("-->", open_ + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith(("<!", "<?"), open_):
            end = page.find(">", open_)
            at = end + 1 if end >= 0 else len(page)
            continue
        m = TAG.match(page, open_)
        if not m:
            out.append("<")
            at = open_ + 1
            continue
        at, name = m.end(), m[2].lower()
        links += [next(v for v in g[1:] if v or v == g[-1]) for g in LINK.findall(m[3])] if m[3] else []
        if name in LINE_TAGS:
            out.append("\n")
        if name == "title":
            in_title = not m[1]
        elif name in SILENT_TAGS and not m[1]:
            if lower is None:
                lower = page.lower() if len(page.lower()) == len(page) else page
            end = lower.find(f"</{name}", at)
            at = end if end >= 0 else len(page)
    out.append(page[at:])
    text = html.unescape("".join(out))
    text = LINES.sub("\n", BLANKS.sub(" ", text)).strip()
    return text, html.unescape("".join(title)).strip(), [html.unescape(x) for x in links]


def split_http(block: bytes) -> tuple[str, list[list[str]], bytes]:
    """(status line, headers, body) of an HTTP response; all of it is body if there is no head."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, _, body = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [[p.strip() for p in x.split(":", 1)] for x in lines if ":" in x], body


def unchunked(body: bytes) -> bytes:
    """A body in chunk framing without it; a broken frame ends it, and what is not framed at all stays as it is."""
    out, at, framed = [], 0, False
    while (end := body.find(b"\r\n", at)) >= 0:
        digits = body[at:end].split(b";")[0].strip()
        if not digits or not set(digits) <= set(b"0123456789abcdefABCDEF") or len(digits) > 15:
            break
        size, framed = int(digits, 16), True
        out.append(body[end + 2:end + 2 + size])
        at = end + 2 + size + 2
        if not size:
            break
    return b"".join(out) if framed else body


def inflated(data: bytes, raw: bool = False) -> bytes:
    """What gzip or deflate data give before they end or break, member by member; other data stay as they are."""
    out, rest = [], data
    while rest and (not out or rest[:2] == b"\x1f\x8b"):
        member, got = zlib.decompressobj(-15 if raw else 47), []
        try:
            for a in range(0, len(rest), 1 << 16):
                got.append(member.decompress(rest[a:a + (1 << 16)]))
                if member.eof:
                    break
        except zlib.error:
            out += got
            if not any(out):
                return data if raw else inflated(data, True) if data[:2] != b"\x1f\x8b" else b""
            break
        out += got
        if not member.eof:
            break
        rest = member.unused_data + rest[a + (1 << 16):]
    return b"".join(out)


def payload(http: list[list[str]], body: bytes) -> bytes:
    """The body without its transfer and content encodings, as far as they are known."""
    fields = {k.lower(): v.lower() for k, v in http}
    if "chunked" in fields.get("transfer-encoding", ""):
        body = unchunked(body)
    if any(x in fields.get("content-encoding", "") for x in ("gzip", "deflate")):
        body = inflated(body)
    return body


def _record(kind: str, source: dict[str, str], content_type: str, block: str) -> dict:
    raw, source = block.encode("utf-8", "replace"), _Fields(source)
    refers = source.get("WARC-Record-ID")
    headers = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers or source}#{kind}')}>",
        "WARC-Refers-To": refers, "WARC-Target-URI": source.get("WARC-Target-URI"), "WARC-Date": source.get("WARC-Date"),
        "WARC-Source-Payload-Digest": source.get("WARC-Payload-Digest"), "WARC-Block-Digest": digest(raw),
        "Content-Type": content_type, "Content-Length": str(len(raw)),
    }
    return {"headers": [(k, v) for k, v in headers.items() if v is not None], "block": raw.decode("utf-8")}


class _Fields(dict):
    """Header fields, whose names have no case."""

    def get(self, name: str, default: str | None = None) -> str | None:
        return super().get(name) or next((v for k, v in self.items() if k.lower() == name.lower()), default)


def derivatives(headers: dict[str, str], block: bytes) -> list[dict]:
    """The derivative records of one record."""
    if (_Fields(headers).get("WARC-Type") or "").lower() != "response":
        return []
    status, http, body = split_http(block)
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    named, kind = CHARSET.search(kind), kind.lower()
    is_html, is_text = "html" in kind or not kind, kind.startswith("text/") or not kind
    said = payload(http, body) if is_html or is_text else b""
    try:
        page = said.decode(named[1] if named else "utf-8", "replace")
    except (LookupError, UnicodeError, ValueError):  # names of no charset, or of one that cannot read it
        page = said.decode("utf-8", "replace")
    text, title, links = page_text(page) if is_html else (page, "", [])
    facts = {"warc": headers, "status": status, "http": http, "payload-length": len(body), "title": title, "links": links}
    out = [_record("metadata", headers, "application/json", json.dumps(facts, ensure_ascii=False))]
    if is_html or is_text:
        out.append(_record("conversion", headers, "text/plain; charset=utf-8", text))
    return out


HEADERS = pa.map_(pa.string(), pa.string())


def derive(records: DataFrame, headers: str = "headers", block: str = "block") -> DataFrame:
    """A row per derivative record: the other columns of its response, then headers and block (text)."""
    kind = pa.list_(pa.struct([("headers", HEADERS), ("block", pa.string())]))

    @F.arrow_udf("array<struct<headers:map<string,string>,block:string>>")
    def made(heads: pa.Array, blocks: pa.Array) -> pa.Array:
        pairs = zip(heads.to_pylist(), blocks.to_pylist(), strict=True)
        return pa.array([derivatives({k: v for k, v in h or () if v is not None}, b or b"") for h, b in pairs], kind)

    others = [F.col(c) for c in records.columns if c not in (headers, block)]
    out = with_text_batches(records).select(*others, F.explode(made(F.col(headers), F.col(block))).alias("_made"))
    return out.select(*others, F.col("_made.headers").alias(headers), F.col("_made.block").alias(block))


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Pages as response records (key, headers, block); null pages have no body."""
    @F.arrow_udf("struct<headers:map<string,string>,block:binary>")
    def made(keys: pa.Array, urls: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for k, u, t in zip(keys.to_pylist(), urls.to_pylist(), texts.to_pylist(), strict=True):
            body = (t or "").encode("utf-8", "replace")
            block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n%b" % (len(body), body)
            head = {
                "WARC-Type": "response", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{u}#{k}')}>",
                "WARC-Target-URI": u, "WARC-Date": date, "WARC-Payload-Digest": digest(body),
                "WARC-Block-Digest": digest(block), "Content-Type": "application/http; msgtype=response",
                "Content-Length": str(len(block)),
            }
            out.append({"headers": [(a, b) for a, b in head.items() if b is not None], "block": block})
        return pa.array(out, pa.struct([("headers", HEADERS), ("block", pa.binary())]))

    d = pages.select(F.col(key).alias(key), made(F.col(key).cast("string"), F.col(url).cast("string"), F.col(page).cast("string")).alias("_r"))
    return d.select(key, "_r.headers", "_r.block")


def write_records(records: DataFrame, path: str, compression: str = "gzip", headers: str = "headers", block: str = "block") -> None:
    """Write records with text blocks as WARC files, one per partition."""
    fields = F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\r\n")))
    record = F.concat(F.lit("WARC/1.0\r\n"), F.array_join(fields, ""), F.lit("\r\n"), F.coalesce(F.col(block), F.lit("")))
    records.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a file.

    A broken tail, also of compressed files, ends it; a record without a usable length is left out; fields that are
    repeated are joined with a comma.
    """
    data = inflated(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while (head := data.find(b"WARC/", at)) >= 0 and (end := data.find(b"\r\n\r\n", head)) >= 0:
        headers: dict[str, str] = {}
        for line in data[head:end].decode("utf-8", "replace").split("\r\n")[1:]:
            if ":" in line:
                name, value = (p.strip() for p in line.split(":", 1))
                headers[name] = f"{headers[name]}, {value}" if name in headers else value
        size = _Fields(headers).get("Content-Length", "0")
        at = end + 4
        if size.isascii() and size.isdigit():
            yield headers, data[at:at + int(size)]
            at += int(size)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, headers, block) of every record of the WARC files under ``path``."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                found = list(parse_records(content))
                yield pd.DataFrame({"path": [name] * len(found), "headers": [h for h, _ in found], "block": [b for _, b in found]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "path string, headers map<string,string>, block binary")
