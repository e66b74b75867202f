"""Byte-level BPE encoding and decoding of configuration documents.

A segment tree over byte positions stores, for every live position, the rank of the pair that
starts there; its root is the leftmost pair of least rank. A merge changes three leaves (the
merged position, the position that dies and the live neighbour on the left), each updated in
logarithmic time. Short pieces of one batch are worked through side by side, one tree per
row; a long piece has a tree of its own.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from canopygrid.llm.common import need, slices, texts_of

NONE = np.int64(1) << 62
POS = (1 << 31) - 1
SIDE_BY_SIDE = 256  # leaves: longer pieces get their own tree
CACHE_PIECES = 120_000


class Vocabulary:
    """Ranks, byte strings and the pairs that merge into each token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.first = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.n = max(ranks.values()) + 1

    @functools.cached_property
    def pairs(self) -> dict[int, int]:
        """Rank of every pair that merges, by left * n + right. Decoding does without it."""
        ranks = self.ranks
        return {ranks[b[:i]] * self.n + ranks[b[i:]]: r for b, r in ranks.items()
                for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks}

    @functools.cached_property
    def keys(self) -> np.ndarray:
        return np.array(sorted(self.pairs), dtype=np.int64)

    @functools.cached_property
    def values(self) -> np.ndarray:
        return np.array([self.pairs[k] for k in self.keys.tolist()], dtype=np.int64)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where the two do not merge."""
        if not len(self.keys):
            return np.full(left.shape, NONE)
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[i] = r.to_bytes(4, "little")
            elif p:
                by_size.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
        for leaves, which in by_size.items():
            if leaves > SIDE_BY_SIDE:
                for i in which:
                    out[i] = self._alone(pieces[i], leaves)
                continue
            rows = max(1, (1 << 19) // leaves)
            for at in range(0, len(which), rows):
                part = which[at:at + rows]
                for i, ids in zip(part, self._side_by_side([pieces[i] for i in part], leaves), strict=True):
                    out[i] = ids
        return out

    def _side_by_side(self, pieces: list[bytes], leaves: int) -> list[bytes]:
        """One tree per row of a two-dimensional array; each turn merges once in every row."""
        n = len(pieces)
        length = np.array([len(p) for p in pieces])
        flat = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), dtype=np.uint8).reshape(n, leaves)
        token = self.first[flat]
        column = np.arange(leaves)
        after = np.where(column + 1 < length[:, None], column + 1, leaves)  # leaves: no neighbour
        before = np.tile(column - 1, (n, 1))
        alive = column < length[:, None]
        tree = np.full((n, 2 * leaves), NONE)
        rank = self.rank(token[:, :-1], token[:, 1:])
        there = after[:, :-1] < leaves
        tree[:, leaves:-1] = np.where(there & (rank < NONE), (rank << 31) | column[:-1], NONE)
        node = leaves
        while node > 1:
            half = node // 2
            tree[:, half:node] = np.minimum(tree[:, node:2 * node:2], tree[:, node + 1:2 * node:2])
            node = half
        rows = np.nonzero(tree[:, 1] < NONE)[0]
        while len(rows):
            top = tree[rows, 1]
            at, merged = top & POS, top >> 31
            gone = after[rows, at]
            beyond = after[rows, gone]
            token[rows, at] = merged
            alive[rows, gone] = False
            after[rows, at] = beyond
            has = beyond < leaves
            before[rows[has], beyond[has]] = at[has]
            behind = before[rows, at]
            # leaves of the merged position, of the left neighbour and of the dead position
            right = token[rows, np.minimum(beyond, leaves - 1)]
            own = self.rank(merged, right)
            tree[rows, leaves + at] = np.where(has & (own < NONE), (own << 31) | at, NONE)
            tree[rows, leaves + gone] = NONE
            left = behind >= 0
            r, b = rows[left], behind[left]
            before_it = self.rank(token[r, b], merged[left])
            tree[r, leaves + b] = np.where(before_it < NONE, (before_it << 31) | b, NONE)
            three = np.stack([at, gone, np.where(left, behind, at)], axis=1) + leaves
            line = rows[:, None]
            size = leaves
            while size > 1:
                three >>= 1
                tree[line, three] = np.minimum(tree[line, 2 * three], tree[line, 2 * three + 1])
                size >>= 1
            rows = rows[tree[rows, 1] < NONE]
        ids = token[alive].astype("<u4").tobytes()
        ends = (np.cumsum(alive.sum(axis=1)) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _alone(self, piece: bytes, leaves: int) -> bytes:
        """The same for one long piece, with plain lists."""
        n, pairs, top = len(piece), self.pairs, int(NONE)
        token = self.first[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before, alive = [*range(1, n), leaves], list(range(-1, n - 1)), bytearray(b"\1" * n)
        tree = [top] * (2 * leaves)
        for i in range(n - 1):
            r = pairs.get(token[i] * self.n + token[i + 1])
            if r is not None:
                tree[leaves + i] = (r << 31) | i
        for k in range(leaves - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = leaves + i
            tree[k] = value
            while k > 1:
                k >>= 1
                a, b = tree[2 * k], tree[2 * k + 1]
                value = a if a < b else b
                if tree[k] == value:
                    return
                tree[k] = value

        while tree[1] < top:
            at, merged = tree[1] & POS, tree[1] >> 31
            gone = after[at]
            beyond = after[gone]
            token[at], after[at], alive[gone] = merged, beyond, 0
            put(gone, top)
            r = None
            if beyond < leaves:
                before[beyond] = at
                r = pairs.get(merged * self.n + token[beyond])
            put(at, top if r is None else (r << 31) | at)
            if (b := before[at]) >= 0:
                r = pairs.get(token[b] * self.n + merged)
                put(b, top if r is None else (r << 31) | b)
        return np.array([t for t, a in zip(token, alive, strict=True) if a], dtype="<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker process."""
    return Vocabulary.read(path)


class Encoder:
    """Splits texts by a pattern and encodes the pieces, each different piece once while cached."""

    def __init__(self, vocab: Vocabulary, pattern: str):
        self.vocab, self.split, self.cache = vocab, regex.compile(pattern).findall, {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        pieces = [self.split(t) for t in texts]
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        new: set[str] = set()
        for p in pieces:
            new.update(p)
        fresh = [p for p in new if p not in self.cache]
        # a lone surrogate cannot come from a table; "replace" keeps such input from failing
        self.cache.update(zip(fresh, self.vocab.encode([p.encode("utf-8", "replace") for p in fresh]), strict=True))
        get = self.cache.__getitem__
        return [b"".join(map(get, p)) for p in pieces]


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(vocabulary(path), pattern)


def local_path(path: str) -> str:
    """A vocabulary path as it is on every machine, or the name of a file sent with the job."""
    return SparkFiles.get(path.removeprefix("files:")) if path.startswith("files:") else path


def encode_docs(cfgs: DataFrame, vocab: str, pattern: str, name: str = "name", doc: str = "doc",
                decoded: str | None = None) -> DataFrame:
    """Token ids of every whole document: ``name, n_tokens, ids``.

    With ``decoded``, a column of that name holds the bytes decoded from the ids again, in the
    same pass (a worker process less than with ``decode_docs`` after it).

    ``ids`` is binary, little-endian unsigned 32-bit. ``vocab`` is a rank file present on every
    machine (or ``files:x`` for one added with ``spark.addFile``); matches of ``pattern`` are
    encoded separately; characters outside all matches are dropped, as the rank library does. A null or empty document has no ids. Row by row:
    repeated rows give repeated results, other columns are ignored, an empty table gives no rows.
    """
    need(cfgs, name, doc)
    out = T.StructType([T.StructField("name", cfgs.schema[name].dataType), T.StructField("n_tokens", T.LongType()),
                        T.StructField("ids", T.BinaryType()), *([T.StructField("back", T.BinaryType())] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(local_path(vocab), pattern)
        for b in slices(batches, "doc"):
            ids = enc(texts_of(b, "doc"))
            columns = [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array(map(enc.vocab.decode, ids), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    done = cfgs.select(cfgs[name].alias("name"), cfgs[doc].cast("string").alias("doc")).mapInArrow(run, out)
    return done.withColumnsRenamed({"name": name} | ({"back": decoded} if decoded else {}))


def decode_docs(encoded: DataFrame, vocab: str, ids: str = "ids", into: str = "doc_bytes") -> DataFrame:
    """Replace ``ids`` with the decoded bytes as ``into``; null ids give null, none give empty bytes."""
    need(encoded, ids)
    at = encoded.columns.index(ids)
    fields = [*encoded.schema.fields]
    fields[at] = T.StructField(into, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(local_path(vocab))
        for b in batches:
            columns = [*b.columns]
            columns[at] = pa.array([None if x is None else v.decode(x) for x in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return encoded.mapInArrow(run, T.StructType(fields))
