"""WARC derivatives: metadata and plain-text conversion records made from response records.

A response record gives two records. The conversion record holds the page's plain text; the metadata record holds
the source's headers, digests and outgoing facts as ``name: value`` lines (application/warc-fields). Both name the
response in WARC-Refers-To and keep its target URI, date and payload digest; the metadata record also names the
conversion. Record ids are name-based (version 5) UUIDs of the response's id and the record's kind, so a rerun
gives the same ids. The work is a map over records: no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_beside, table

RECORD = "record_id string, warc_type string, target_uri string, date string, refers_to string, content_type string, headers map<string,string>, block_digest string, payload_digest string, block binary"
#: Bytes of a file that are read at once, that a decompressor gets at once, and of blocks that are handed on together.
BLOCK, STEP, OUT = 1 << 20, 1 << 14, 64 << 20
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space for URLs

_HIDDEN = re.compile(r"<!--|<!\[CDATA\[|<(script|style|noscript|template|svg)(?=[\s/>])", re.I)
_ENDS = {"<!--": re.compile("-->"), "<![cdata[": re.compile(r"\]\]>")} | {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "noscript", "template", "svg")}
#: What hides all that follows if it is not ended.
_TO_END = ("<!--", "script", "style")
_WHOLE_TAG = re.compile(r"<[^\"'>]*(?:\"[^\"]*\"[^\"'>]*|'[^']*'[^\"'>]*)*>")
#: Elements that end a line, and those that stand in one beside others.
_BREAKS = frozenset("p div br hr li ul ol dl dt dd tr table thead tbody h1 h2 h3 h4 h5 h6 section article header footer nav main aside form blockquote pre title head body html option figure figcaption".split())
_CELLS = frozenset(("td", "th"))
#: A tag up to the sign that ends it: not one inside a quoted value.
_TAG = re.compile(r"<(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9]*)(?=[\s/]|$)")
_TITLE, _TITLE_END = re.compile(r"<title(?=[\s/>])", re.I), re.compile(r"</title\s*>", re.I)
_HTML, _LANG = re.compile(r"<html(?=[\s/>])", re.I), re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_LINK, _HREF = re.compile(r"<a(?=[\s/>])", re.I), re.compile(r"\bhref\s*=", re.I)


def digest(block: bytes) -> str:
    """A labelled digest as WARC headers carry it: SHA-1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def urn(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, name)}>"


def _without_hidden(page: str) -> str:
    """page with a blank for each comment, script, style and other element that shows no text.

    A self-closed svg is one tag. Of other elements without an end tag only script and style hide what follows.
    """
    out, kept, at, unended, quoted = [], 0, 0, set(), True
    while m := _HIDDEN.search(page, at):
        name = (m[1] or m[0]).lower()
        at = m.end()
        tag = _WHOLE_TAG.match(page, m.start()) if name == "svg" and quoted else None
        if name == "svg" and tag is None:
            quoted = False  # a tag without an end: others are not looked at, so that the work stays linear
        end = tag if tag and tag[0].endswith("/>") else None
        if end is None and name not in unended:
            end = _ENDS[name].search(page, at)
        if end is None and name not in _TO_END:
            unended.add(name)
            at = tag.end() if tag else at
            continue
        out += [page[kept : m.start()], " "]
        kept = at = end.end() if end else len(page)
    return "".join([*out, page[kept:]])


def _without_tags(page: str) -> str:
    """page without its tags in one pass: a line end for those of block elements, a blank for those of cells."""
    out, at, start = [], 0, page.find("<")
    while start >= 0:
        if not (page[start + 1 : start + 2].isascii() and (page[start + 1 : start + 2].isalpha() or page[start + 1 : start + 2] in ("!", "/", "?"))):
            start = page.find("<", start + 1)
            continue
        tag = _TAG.match(page, start)
        if tag is None:
            break
        end = tag.end() - 1
        m = _NAME.match(page[start + 1 : end])
        name = m[1].lower() if m else ""
        out += [page[at:start], "\n" if name in _BREAKS else " " if name in _CELLS else ""]
        at, start = end + 1, page.find("<", end + 1)
    return "".join([*out, page[at:]])


def _first_tag(page: str, pattern: re.Pattern) -> tuple[str, int]:
    """What the first tag that the pattern starts holds, and where it ends; empty where there is none."""
    m = pattern.search(page)
    end = page.find(">", m.end()) if m else -1
    return (page[m.end() : end], end + 1) if end >= 0 else ("", -1)


def _outlinks(page: str) -> int:
    """The number of anchors with an address."""
    n = at = 0
    while (m := _LINK.search(page, at)) and (end := page.find(">", m.end())) >= 0:
        n += bool(_HREF.search(page, m.end(), end))
        at = end
    return n


def plain_text(page: str) -> str:
    """The visible text of a page: block elements end lines, scripts and comments go, entities are decoded, runs of blanks close up."""
    page = _without_hidden(page)
    page = _without_tags(page)
    lines = (" ".join(x.split()) for x in html.unescape(page).split("\n"))
    return "\n".join(x for x in lines if x)


def split_http(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers (names in lower case, repeated ones joined by commas) and payload of an HTTP response."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return "", {}, block
    first, *rest = head.decode("latin-1").split("\r\n")
    headers: dict[str, list[str]] = {}
    for k, v in (x.split(":", 1) for x in re.sub(r"\n[ \t]+", " ", "\n".join(rest)).split("\n") if ":" in x):
        headers.setdefault(k.strip().lower(), []).append(v.strip())
    return first, {k: ", ".join(v) for k, v in headers.items()}, payload


def _dechunked(body: bytes) -> bytes:
    """The body of a chunked message; what does not read as chunks is left as it is."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,12}", size):
            return body
        if not (n := int(size, 16)):
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out) if out else body


def _inflate(payload: bytes, bits: int) -> bytes:
    """What a compressed body holds; of one that is cut off, the part that can be read."""
    one = zlib.decompressobj(bits)
    return one.decompress(payload) + one.flush()


def decoded_body(headers: dict[str, str], payload: bytes) -> bytes:
    """The payload without its transfer and content encodings (chunked, gzip, deflate); what fails to decode is left as it is, a body that is cut off gives what can be read."""
    if "chunked" in headers.get("transfer-encoding", "").lower():
        payload = _dechunked(payload)
    for kind in reversed([x.strip().lower() for x in headers.get("content-encoding", "").split(",")]):
        try:
            if kind in ("gzip", "x-gzip"):
                payload = _inflate(payload, 47)
            elif kind == "deflate":
                payload = _inflate(payload, 15 if payload[:1] and payload[0] & 15 == 8 else -15)
        except zlib.error:
            break
    return payload


def _one_line(value: str) -> str:
    return " ".join(value.split())


def derive(record_id: str, target_uri: str | None, date: str | None, block: bytes) -> list[dict]:
    """The metadata and the conversion record of one response."""
    status, headers, payload = split_http(block)
    source_digest = digest(payload)
    body = decoded_body(headers, payload)
    charsets = re.findall(r"charset=[\"']?([\w-]+)", headers.get("content-type", ""), re.I)
    try:
        page = body.decode(charsets[-1] if charsets else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    text = plain_text(page).encode("utf-8", "replace")
    conversion_id, metadata_id = urn(f"{record_id}#conversion"), urn(f"{record_id}#metadata")
    at = _first_tag(page, _TITLE)[1]
    title_end = _TITLE_END.search(page, at) if at >= 0 else None
    title, lang = html.unescape(page[at : title_end.start()]) if title_end else "", _LANG.search(_first_tag(page, _HTML)[0])
    source = {f"source-{k}": v for k, v in headers.items()}
    fields = [("status", status), *source.items()]
    fields += [("title", title), ("language", lang[1] if lang else ""), ("outlinks", str(_outlinks(page)))]
    fields += [("source-payload-length", str(len(payload))), ("source-payload-digest", source_digest), ("text-length", str(len(text))), ("text-digest", digest(text)), ("conversion", conversion_id)]
    about = "".join(f"{k}: {_one_line(v)}\r\n" for k, v in fields if v).encode("utf-8", "replace")
    common = {"target_uri": target_uri, "date": date, "refers_to": record_id, "payload_digest": source_digest}
    return [
        common | {"record_id": metadata_id, "warc_type": "metadata", "content_type": "application/warc-fields", "headers": source, "block_digest": digest(about), "block": about},
        common | {"record_id": conversion_id, "warc_type": "conversion", "content_type": "text/plain; charset=utf-8", "headers": source, "block_digest": digest(text), "block": text},
    ]


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records (schema RECORD and the other columns of the input) for each response record.

    ``responses`` has record_id, target_uri, date (strings) and block (binary: HTTP headers and payload, or a bare
    payload). A null block is an empty one and gives an empty text; a null record_id is named by the block's
    digest, so that the two records still agree. Other columns are carried along, but for those that clash with
    RECORD's. Repeated rows all stay. Chunked and compressed payloads are decoded for the text, digests are of the payload
    as it came. Work is linear in a page's length, however its tags are broken.
    """
    names = [x.split()[0] for x in RECORD.split(", ")]
    others = [c for c in responses.columns if c not in names]

    def work(batch: dict[str, list]) -> Iterator[tuple[int, tuple]]:
        for i, (rid, uri, date, block) in enumerate(zip(*(batch[c] for c in ("record_id", "target_uri", "date", "block")), strict=True)):
            block = block or b""
            for record in derive(urn(digest(block)) if rid is None else rid, uri, date, block):
                yield i, tuple(list(record[n].items()) if n == "headers" else record[n] for n in names)

    return map_beside(responses, others, {c: F.col(c) for c in ("record_id", "target_uri", "date", "block")}, RECORD, work)


def _inflated(blocks: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of a file that may be compressed record by record, one decompressor for each member.

    A decompressor gets slices of STEP bytes, so what it hands back when a member ends is short. What follows the
    last whole member and is none is left out.
    """
    member, compressed = None, None
    for block in blocks:
        if compressed is None and block:
            compressed = block[:2] == b"\x1f\x8b"
        if not compressed:
            yield block
            continue
        view, at = memoryview(block), 0
        while at < len(view):
            member = member or zlib.decompressobj(31)
            end = min(at + STEP, len(view))
            try:
                out = member.decompress(view[at:end])
            except zlib.error:
                return
            at = end - len(member.unused_data)
            member = None if member.eof else member
            if out:
                yield out


def parse_records(source: bytes | Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a WARC file, plain or compressed record by record.

    ``source`` is the file's bytes or its blocks in order. Records come as they are read: no more than one record, and
    what a block inflates to, is held. A record cut off by the file's end comes with the bytes that are there.
    """
    blocks = _inflated(_sliced(source) if isinstance(source, bytes | bytearray | memoryview) else source)
    held = bytearray()

    def more() -> bool:
        for block in blocks:
            held.extend(block)
            return True
        return False

    while True:
        while (start := held.find(b"WARC/")) < 0:
            del held[: max(0, len(held) - 4)]
            if not more():
                return
        del held[:start]
        seen = 0
        while (gap := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            if not more():
                return
        pairs = (x.split(":", 1) for x in held[:gap].decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
        headers = {k.strip().lower(): v.strip() for k, v in pairs}
        end = gap + 4 + (int(headers["content-length"]) if headers.get("content-length", "").isdigit() else 0)
        while len(held) < end and more():
            pass
        yield headers, bytes(held[gap + 4 : end])
        del held[:end]


def _sliced(raw: bytes | memoryview) -> Iterator[bytes]:
    view = memoryview(raw)
    for at in range(0, len(view), BLOCK):
        yield bytes(view[at : at + BLOCK])


def _blocks_of(path: str) -> Iterator[bytes]:
    """The blocks of a file of any store that Arrow opens: local, HDFS, S3 and the like."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_stream(name, compression=None) as f:
        while block := f.read(BLOCK):
            yield block


def read_responses(spark: SparkSession, path: str, stream: bool = True) -> DataFrame:
    """The response records (record_id, target_uri, date, block) of the WARC files under path, as derivatives() takes them.

    One task reads a file, which cannot be entered in its middle, in blocks: it holds a batch of records, not the
    file. Spark lists the files; a task opens them by Arrow. ``stream=False`` has Spark read them, for stores that
    Arrow does not know; a file is then held whole and may have 2 GB at most.
    """
    names = ["record_id", "target_uri", "date", "block"]

    def responses(source: bytes | Iterable[bytes]) -> Iterator[tuple]:
        for h, block in parse_records(source):
            if h.get("warc-type") == "response":
                yield h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), block

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for held in batch["held"]:
                rows, size = [], 0
                for row in responses(_blocks_of(held) if stream else bytes(held)):
                    rows.append(row)
                    size += len(row[3])
                    if size > OUT:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").load(path)
    held = files.select(F.col("path" if stream else "content").alias("held"))
    if stream:  # paths alone are small: each is dealt to a task of its own
        held = held.repartition(max(1, held.count()), "held")
    return held.mapInPandas(run, "record_id string, target_uri string, date string, block binary")


def serialise(records: DataFrame) -> DataFrame:
    """records with ``warc``: the record as the bytes of a WARC/1.1 file, ready to be joined to others."""

    @F.pandas_udf("binary")
    def to_bytes(rid: pd.Series, kind: pd.Series, uri: pd.Series, date: pd.Series, refers: pd.Series, content: pd.Series, block_digest: pd.Series, payload_digest: pd.Series, block: pd.Series) -> pd.Series:
        out = []
        for r, k, u, d, f, c, b, p, x in zip(rid, kind, uri, date, refers, content, block_digest, payload_digest, block, strict=True):
            x = bytes(x) if x is not None else b""
            pairs = [("WARC-Type", k), ("WARC-Record-ID", r), ("WARC-Target-URI", u), ("WARC-Date", d), ("WARC-Refers-To", f), ("Content-Type", c), ("WARC-Block-Digest", b), ("WARC-Payload-Digest", p), ("Content-Length", str(len(x)))]
            head = "WARC/1.1\r\n" + "".join(f"{name}: {_one_line(v)}\r\n" for name, v in pairs if isinstance(v, str)) + "\r\n"
            out.append(head.encode("utf-8", "replace") + x + b"\r\n\r\n")
        return pd.Series(out)

    return records.withColumn("warc", to_bytes("record_id", "warc_type", "target_uri", "date", "refers_to", "content_type", "block_digest", "payload_digest", "block"))


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records (page_id, record_id, target_uri, date, block) of a table of pages (page_id, url, html).

    A null url or html is an empty block's; the record id follows from page_id and url.
    """
    name = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))))
    rid = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    body = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select("page_id", rid.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.encode(F.concat(head, body), "UTF-8").alias("block"))


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows per page: its metadata and conversion records, the block as text."""
    records = derivatives(responses_of_pages(table(spark, sf_dir, "pages")))
    return records.select(
        "page_id", "record_id", "warc_type", "target_uri", "date", "refers_to", "content_type", F.element_at("headers", "source-content-type").alias("source_content_type"),
        "payload_digest", "block_digest", F.octet_length("block").cast("long").alias("content_length"), F.decode("block", "UTF-8").alias("content"),
    )
