"""Token counts of the fields or sections of a document, from one encoding of the whole document.

A document is encoded once. The byte lengths of its tokens give each token's byte span, and the positions of
UTF-8 lead bytes turn those into character spans. Sections are character spans too, so a token is attributed by an
interval join of two sorted lists of spans: a binary search per token, not a loop over sections. A token that
crosses a boundary is allocated by an explicit rule:

``start``  the section that holds the token's first character;
``most``   the section that holds most of its bytes, the earlier one of equal ones;
``share``  every section it touches, by share of its bytes (counts are then fractions).

A token with no byte in any section counts as ``outside``. With ``start`` and ``most``, a document's counts and its
outside tokens add up to its tokens; with ``share`` they do so within rounding of doubles.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_beside, table

ADDED = "n_tokens long, n_crossing long, outside double, sections array<struct<name:string,start:int,end:int,tokens:double>>"
RULES = ("start", "most", "share")
#: Characters that are encoded at once: longer texts are cut where the splitting pattern has a boundary anyway.
PART = 1 << 20

_made: dict[tuple[str, str], tuple] = {}


def _encoder(path: str, pattern: str) -> tuple:
    """The encoding and each token's length in bytes, once for each worker process."""
    if (path, pattern) not in _made:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            lengths[rank] = len(piece)
        _made[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _made[path, pattern]


def _parts(text: str) -> Iterator[str]:
    """A long text in parts; a cut is before a newline that stands between two other characters than white space.

    Such a newline is a piece of its own under the splitting pattern, so the parts' tokens are the whole text's.
    """
    start = 0
    while len(text) - start > PART:
        cut = text.rfind("\n", start + 1, start + PART)
        while cut > start and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.rfind("\n", start + 1, cut)
        if cut <= start:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def token_ends(text: str, path: str, pattern: str) -> np.ndarray:
    """The byte offset at which each token of the text ends."""
    enc, lengths = _encoder(path, pattern)
    ids = [np.asarray(enc.encode_to_numpy(p, disallowed_special=()), np.int64) for p in _parts(text) if p]
    return np.cumsum(lengths[np.concatenate(ids)]) if ids else np.zeros(0, np.int64)


def attribute(ends: np.ndarray, text: str, spans: np.ndarray, rule: str) -> tuple[np.ndarray, int, float]:
    """(count of each span, tokens that cross a boundary, tokens outside); spans: rows of (start, end) in characters.

    Spans are clipped to the text and may leave gaps. What several spans hold is that of the one that starts first, or of
    the first given of those.
    """
    counts = np.zeros(len(spans))
    if not len(ends) or not len(spans):
        return counts, 0, float(len(ends))
    if text.isascii():
        at = np.clip(spans, 0, len(text))
    else:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        lead = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # the byte offset of each character
        at = lead[np.clip(spans, 0, len(text))]
    order = np.argsort(at[:, 0], kind="stable")
    lo, hi = at[order, 0].copy(), np.maximum(at[order, 1], at[order, 0])
    lo[1:] = np.maximum(lo[1:], np.maximum.accumulate(hi)[:-1])
    hi = np.maximum(hi, lo)
    starts = ends - np.diff(ends, prepend=0)
    # the spans that a token can touch are first..last
    first, last = np.searchsorted(hi, starts, "right"), np.searchsorted(lo, ends, "left") - 1
    inside = (first <= last) & (first < len(lo))
    f = np.minimum(first, len(lo) - 1)
    whole = inside & (lo[f] <= starts) & (ends <= hi[f])
    add = np.zeros(len(lo))
    add += np.bincount(f[whole], minlength=len(lo))
    outside, crossing = float((~inside).sum()), np.flatnonzero(inside & ~whole)
    for t in crossing.tolist():
        touched = np.arange(first[t], last[t] + 1)
        held = np.maximum(np.minimum(hi[touched], ends[t]) - np.maximum(lo[touched], starts[t]), 0)
        if rule == "share":
            part = held / (ends[t] - starts[t])
            add[touched] += part
            outside += 1.0 - part.sum()
        elif rule == "most":
            # bytes in gaps belong to no section and do not outvote one
            add[touched[np.argmax(held)]] += 1.0
        elif lo[touched[0]] <= starts[t]:
            add[touched[0]] += 1.0
        else:
            outside += 1.0
    counts[order] = add
    return counts, len(crossing), outside


def count_tokens(docs: DataFrame, path: str, pattern: str, sections: str | None = None, rule: str = "most", text_col: str = "text") -> DataFrame:
    """docs without the text, with n_tokens (long), n_crossing (long), outside (double) and
    sections (array<struct<name, start, end, tokens>>), in the order in which they are given.

    ``sections`` names a column array<struct<name:string,start:int,end:int>> of character spans, which is replaced;
    without it each line is a section: the first is the title, the others are body. Null and empty texts have no
    tokens, and each of their sections counts 0. Null sections are none: all tokens are outside. A null bound or
    one beyond the text is the text's end. Where sections overlap, the one that starts first has the text. Repeated rows all stay; columns that clash with the added ones are
    replaced, others pass through whatever their names. Whole texts are read, however long.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    added = ("n_tokens", "n_crossing", "outside", "sections")
    others = [c for c in docs.columns if c not in (*added, text_col, sections)]

    def work(batch: dict[str, list]) -> Iterator[tuple[int, tuple]]:
        for i, t in enumerate(batch["text"]):
            t = t or ""
            if sections is None:
                edges = np.cumsum([0, *(len(x) + 1 for x in t.split("\n"))])
                spans = np.stack([edges[:-1], np.minimum(edges[1:], len(t))], 1)
                names = ["title", *["body"] * (len(spans) - 1)]
            else:
                own = [s for s in batch["sections"][i] or () if s is not None]
                names = [s["name"] for s in own]
                spans = np.array([[len(t) if s[k] is None else s[k] for k in ("start", "end")] for s in own], np.int64).reshape(-1, 2)
            ends = token_ends(t, path, pattern)
            counts, crossing, outside = attribute(ends, t, spans, rule)
            out = [{"name": n, "start": a, "end": b, "tokens": c} for n, (a, b), c in zip(names, np.clip(spans, 0, len(t)).tolist(), counts.tolist(), strict=True)]
            yield i, (len(ends), crossing, float(outside), out)

    held = {"text": F.col(f"`{text_col}`"), **({"sections": F.col(f"`{sections}`")} if sections else {})}
    return map_beside(docs, others, held, ADDED, work)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens, those of the title line and of the body, the longest section's, and boundary crossings."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    tokens = F.transform("sections", lambda s: s["tokens"])
    title = F.coalesce(F.get(tokens, 0), F.lit(0.0))
    return counted.select(
        "doc_id", "n_tokens", F.size("sections").cast("long").alias("n_sections"), title.cast("long").alias("title_tokens"),
        (F.col("n_tokens") - title - F.col("outside")).cast("long").alias("body_tokens"), F.array_max(tokens).cast("long").alias("longest_section_tokens"), "n_crossing",
    )
