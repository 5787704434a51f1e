"""Byte-level BPE encoding and decoding.

A text is cut into the matches of the pre-tokenisation pattern. Each match is merged on its own: a segment tree
over its byte positions stores, for every range, the leftmost minimum of (pair rank, position). The root names
the next merge; a merge changes the pairs of at most three positions, each a logarithmic point update on live
neighbours. So one match of n bytes costs O(n log n), also when a text has no space at all.

Ids are carried as BINARY, little-endian unsigned 32-bit each (``octet_length / 4`` is their number). Every
worker keeps one bounded memo of the ids of short matches; the memo only saves time.

Defined cases: a null or empty text has no ids and decodes to no bytes; an id outside the vocabulary raises; a text is
encoded whole however long it is; repeated rows get equal ids; an empty table gives an empty result; other columns
are not looked at, whatever their names, since the tokenizer maps one column to another.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

#: Matches that the older and the newer half of a worker's memo hold each, and the bytes of ids of the longest one kept:
#: at most about 50 MB in all.
MEMO, MEMO_BYTES = 120_000, 64
#: Children of a node of the segment tree.
FAN = 32
_NONE = 1 << 62
_CODECS: dict[tuple[bytes, str], "Codec"] = {}


def merge(piece: bytes, ranks: dict[bytes, int], pairs: list[int]) -> list[int]:
    """Ids of one match.

    The tree's nodes have FAN children, so that a node's minimum is one call; matches of up to FAN + 1 bytes,
    nearly all, have a root and leaves only.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get = len(piece), ranks.get
    if n < 2:
        return [ranks[piece]] if n else []
    leaves = [x + i for i, x in enumerate([pairs[x << 8 | y] for x, y in zip(piece, piece[1:])])]
    levels = [leaves]
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append([min(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    top = levels[-1]
    after, before = [*range(1, n + 2)], [*range(-1, n)]
    while (least := min(top)) < _NONE:
        i = least & 0xFFFFFFFF
        j = after[i]
        k = after[i] = after[j]
        before[k] = i
        if k < n:
            rank = get(piece[i : after[k]])
            leaves[i] = _NONE if rank is None else rank << 32 | i
            leaves[j] = _NONE
        else:
            leaves[i] = _NONE
            if j < n - 1:
                leaves[j] = _NONE
        h = before[i]
        if h >= 0:
            rank = get(piece[h:k])
            leaves[h] = _NONE if rank is None else rank << 32 | h
        if top is not leaves:
            for at in (i, j, h):
                if 0 <= at < n - 1:
                    for low, high in zip(levels, levels[1:]):
                        at //= FAN
                        least = min(low[at * FAN : at * FAN + FAN])
                        if high[at] == least:
                            break
                        high[at] = least
    out, i = [], 0
    while i < n:
        k = after[i]
        out.append(ranks[piece[i:k]])
        i = k
    return out


class _Memo(dict):
    """Ids of short matches. When it is full, it becomes the older half, and what is asked for again moves back."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, match: str) -> bytes:
        ids = self.older.get(match)
        if ids is None:
            ids = self.make(match)
            if len(ids) > MEMO_BYTES or len(match) > MEMO_BYTES:
                return ids
        if len(self) >= MEMO:
            self.older = dict(self)
            self.clear()
        self[match] = ids
        return ids


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.bytes_of: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
        self.pairs = [_NONE if (rank := ranks.get(bytes((x >> 8, x & 255)))) is None else rank << 32 for x in range(1 << 16)]
        self.memo = _Memo(self.match)

    def match(self, text: str) -> bytes:
        ids = merge(text.encode(), self.ranks, self.pairs)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.find(text))) if text else b""

    def decode(self, ids: bytes) -> bytes:
        try:
            return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))) if ids else b""
        except (IndexError, TypeError):
            raise ValueError("an id is outside the vocabulary") from None


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks from lines of base64 bytes and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def codec_of(raw: bytes, pattern: str) -> Codec:
    """This process's codec, made once."""
    key = (hashlib.sha256(raw).digest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(read_ranks(raw), pattern)
    return _CODECS[key]


class Tokenizer:
    """``encode`` and ``decode`` as Columns, and ``round_trip`` for both in one pass. The vocabulary (fixed, under 1 MB) is broadcast once."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        bounded_batches(spark)
        with open(path, "rb") as f:
            shared = spark.sparkContext.broadcast(f.read())

        @F.arrow_udf(T.BinaryType())
        def encode(texts: pa.Array) -> pa.Array:
            codec = codec_of(shared.value, pattern)
            return pa.array((codec.encode(x.as_py() or "") for x in texts), pa.binary())

        @F.arrow_udf(T.BinaryType())
        def decode(ids: pa.Array) -> pa.Array:
            codec = codec_of(shared.value, pattern)
            return pa.array((codec.decode(x.as_py() or b"") for x in ids), pa.binary())

        @F.arrow_udf(T.StructType().add("ids", "binary").add("decoded", "binary"))
        def round_trip(texts: pa.Array) -> pa.Array:
            codec = codec_of(shared.value, pattern)
            ids = pa.array((codec.encode(x.as_py() or "") for x in texts), pa.binary())
            return pa.StructArray.from_arrays([ids, pa.array((codec.decode(x.as_py()) for x in ids), pa.binary())], ["ids", "decoded"])

        # else the optimizer would write the call out again for each use of its result
        self._encode, self._decode, self._both = encode.asNondeterministic(), decode, round_trip.asNondeterministic()

    def encode(self, text: Column) -> Column:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        return self._encode(text)

    def decode(self, ids: Column) -> Column:
        """Bytes of ids."""
        return self._decode(ids)

    def round_trip(self, text: Column) -> Column:
        """Struct of a text's ``ids`` and of what they decode to, ``decoded``: one worker, and the ids cross once."""
        return self._both(text)


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
