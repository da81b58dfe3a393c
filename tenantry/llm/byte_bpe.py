"""Byte-level BPE encoding and decoding.

Each match of the splitting pattern is merged on its own. A piece's bytes are the leaves of a segment tree whose
nodes hold the lowest pair rank below them and, of equal ranks, the leftmost position. The root names the next
merge; it changes the pair at that position and at its live left neighbour and removes the right one, so each
merge updates three leaves and their paths, in time logarithmic in the piece. The trees of many pieces of like
length lie side by side in one array and take their merges in step, so that a step is a few numpy operations.

Texts are read in batches by Spark; a worker keeps the ids of pieces it has seen in a table of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_beside, table

NONE = np.int64(1) << np.int64(62)


class ByteBpe:
    """Encoder and decoder for a rank file; ids are ranks."""

    def __init__(self, path: str, pattern: str, cache: int = 400_000, chunk: int = 1 << 16):
        """cache: pieces whose ids are kept; chunk: pieces of one text that are held at once."""
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern).finditer
        self.find_all = regex.compile(pattern).findall
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
        self.length = np.array([len(x) for x in self.bytes_of], np.int64)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # every way in which a token is made from two others
        keys, out = [], []
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    out.append(rank)
        order = np.argsort(keys, kind="stable")
        self.pair_key, self.pair_rank = np.array(keys, np.int64)[order], np.array(out, np.int64)[order]
        self.whole = {piece: np.array([rank], "<u4").tobytes() for piece, rank in ranks.items()}
        self.cache, self.limit, self.chunk = {}, cache, chunk

    def rank_of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair of ids; NONE where there is none or either id is negative."""
        key = (a << 32) | np.maximum(b, 0)
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where((self.pair_key[at] == key) & (a >= 0) & (b >= 0), self.pair_rank[at], NONE)

    def merge(self, pieces: list[bytes]) -> tuple[bytes, list[int]]:
        """The ids of pieces whose lengths have one power of two as their next: little-endian, and where each piece ends in bytes."""
        n, width = len(pieces), 1 << max(1, (max(map(len, pieces)) - 1).bit_length())
        shift = np.int64(width.bit_length())
        ids = np.full((n, width + 1), -1, np.int64)  # one column past the end, always empty
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        row = np.repeat(np.arange(n), lengths)
        col = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        ids[row, col] = self.byte_id[raw]
        after = np.broadcast_to(np.arange(1, width + 2), (n, width + 1)).copy()  # the live position after each
        before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        after[:, width] = width
        tree = np.full((n, 2 * width), NONE, np.int64)
        pair = self.rank_of_pairs(ids[:, :width].ravel(), ids[:, 1:].ravel()).reshape(n, width)
        # a node is rank << shift | position: the least is the lowest rank, of equal ones the leftmost
        tree[:, width:] = np.where(pair < NONE, (pair << shift) | np.arange(width), NONE)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            best = tree[live, 1]
            at, new = best & ((np.int64(1) << shift) - 1), best >> shift
            gone = after[live, at]
            right = np.minimum(after[live, gone], width)
            left = before[live, at]
            ids[live, at], ids[live, gone] = new, -1
            after[live, at] = right
            before[live, right] = np.where(right < width, at, before[live, right])
            tree[live, width + gone] = NONE
            rank = self.rank_of_pairs(new, ids[live, right])
            tree[live, width + at] = np.where(rank < NONE, (rank << shift) | at, NONE)
            has = left >= 0
            rows, pos = live[has], left[has]
            rank = self.rank_of_pairs(ids[rows, pos], new[has])
            tree[rows, width + pos] = np.where(rank < NONE, (rank << shift) | pos, NONE)
            for leaf_rows, leaf in ((live, gone), (live, at), (rows, pos)):
                node = (width + leaf) >> 1
                while len(leaf_rows) and node[0] >= 1:  # all leaves are at one depth
                    tree[leaf_rows, node] = np.minimum(tree[leaf_rows, 2 * node], tree[leaf_rows, 2 * node + 1])
                    node = node >> 1
            live = live[tree[live, 1] < NONE]
        used = ids[:, :width] >= 0
        return ids[:, :width][used].astype("<u4").tobytes(), (4 * np.cumsum(used.sum(1))).tolist()

    def learn(self, pieces: Iterable[str]) -> None:
        """Put the ids of pieces into the table."""
        groups: dict[int, tuple[list[str], list[bytes]]] = {}
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            if (own := self.whole.get(raw)) is not None:
                self.cache[p] = own
            else:
                bits = (len(raw) - 1).bit_length()
                names, raws = groups.get(bits) or groups.setdefault(bits, ([], []))
                names.append(p)
                raws.append(raw)
        for bits, (names, raws) in groups.items():
            step = max(1, (1 << 16) >> (bits + 1))  # pieces whose trees stay in the processor's cache
            for i in range(0, len(raws), step):
                ids, ends = self.merge(raws[i : i + step])
                start = 0
                for p, end in zip(names[i : i + step], ends, strict=True):
                    self.cache[p] = ids[start:end]
                    start = end

    def _ids_of(self, pieces: list[str]) -> bytes:
        if new := set(pieces).difference(self.cache):
            if len(self.cache) + len(new) > self.limit:
                self.cache.clear()
                new = set(pieces)
            self.learn(new)
        return b"".join(map(self.cache.__getitem__, pieces))

    def encode_chunks(self, text: str) -> Iterator[bytes]:
        """The ids of a text as little-endian 32-bit numbers, for ``chunk`` pieces at a time."""
        if len(text) <= 4 * self.chunk:
            yield self._ids_of(self.find_all(text))
            return
        found = (m.group() for m in self.find(text))
        while pieces := list(itertools.islice(found, self.chunk)):
            yield self._ids_of(pieces)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """As encode() for each of some short texts; new pieces of all of them are merged together."""
        split = [self.find_all(t) for t in texts]
        if new := set(itertools.chain.from_iterable(split)).difference(self.cache):
            if len(self.cache) + len(new) > self.limit:
                self.cache.clear()
                new = set(itertools.chain.from_iterable(split))
            self.learn(new)
        return [b"".join(map(self.cache.__getitem__, pieces)) for pieces in split]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.encode_chunks(text)), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_made: dict[tuple[str, str], ByteBpe] = {}


def encoder(path: str, pattern: str) -> ByteBpe:
    """One encoder for each worker process and vocabulary."""
    if (path, pattern) not in _made:
        _made[path, pattern] = ByteBpe(path, pattern)
    return _made[path, pattern]


def packs(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` characters; a longer text is alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def encode_documents(docs: DataFrame, path: str, pattern: str, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """docs without the text, with n_tokens, ids_sha256 and decoded_sha256, and with_ids the ids (array<long>).

    ids_sha256 is over the ids as little-endian unsigned 32-bit numbers, decoded_sha256 over the bytes that the
    ids decode to, which are the text in UTF-8. A null text is encoded as the empty one: no ids. Columns that
    clash with the added ones are replaced, others pass through whatever their names. Repeated rows all stay. Whole
    texts are encoded, however long.
    """
    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids
    others = [c for c in docs.columns if c != text_col and c not in [x.split()[0] for x in added.split(", ")]]

    def work(batch: dict[str, list]) -> Iterator[tuple[int, tuple]]:
        bpe, texts = encoder(path, pattern), [t or "" for t in batch["text"]]
        for start, end in packs(texts):
            if end - start > 1:
                encoded = ([x] for x in bpe.encode_many(texts[start:end]))
            else:
                encoded = (bpe.encode_chunks(t) for t in texts[start:end])
            for i, chunks in enumerate(encoded, start):
                n, hashed, decoded, kept = 0, hashlib.sha256(), hashlib.sha256(), []
                for chunk in chunks:
                    ids = np.frombuffer(chunk, "<u4")
                    n += len(ids)
                    hashed.update(chunk)
                    decoded.update(bpe.decode(ids))
                    if with_ids:
                        kept.append(ids.astype(np.int64))
                yield i, (n, hashed.hexdigest(), decoded.hexdigest()) + ((np.concatenate(kept) if kept else np.array([], np.int64),) if with_ids else ())

    return map_beside(docs, others, {"text": F.col(f"`{text_col}`")}, added, work)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
