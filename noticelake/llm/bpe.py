"""Byte-level BPE by prefix dynamic programming.

Every prefix of a piece has exactly one valid last token: the last one of the
prefix's own encoding.  A token may follow the encoding of a shorter prefix if
no merge across the boundary would have come before the two tokens stood.  So
``last[i]`` follows from the ``last`` of shorter prefixes alone; an append goes
on where the array ends, and an edit recomputes positions only until they agree
with the old ones over the length of the longest token.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces in each of the two generations of a Python worker's cache.
_KEPT = 160_000
#: Characters, or ids, that are worked on at a time.
_CHUNK = 500_000


#: The splitting pattern with Unicode's white space; the library's own class has four separators more.
_SPACE = r"\p{White_Space}"
_PIECES = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", rf"[^{_SPACE}").replace(r"(?!\S)", rf"(?!\P{{White_Space}})").replace(r"\s", _SPACE))


class Encoder:
    """The vocabulary with what the dynamic programme looks up."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self._table = [self.bytes_of.get(k, b"") for k in range(max(ranks.values()) + 1)]
        self.longest = max(map(len, ranks))
        #: The length of the longest token that ends with these three bytes.
        self._reach: dict[bytes, int] = {}
        for b in ranks:
            if len(b) > 2:
                self._reach[b[-3:]] = max(len(b), self._reach.get(b[-3:], 0))
        self._parts: dict[int, tuple[int, int]] = {}
        self._fits: dict[int, bool] = {}
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def parts(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made this one."""
        if (found := self._parts.get(token)) is None:
            seq = [self.ranks[bytes([b])] for b in self.bytes_of[token]]
            while len(seq) > 2:
                best, at = min((self.ranks.get(self.bytes_of[a] + self.bytes_of[b], 1 << 60), i) for i, (a, b) in enumerate(zip(seq, seq[1:])))
                seq[at : at + 2] = [best]
            self._parts[token] = found = (seq[0], seq[1])
        return found

    def _made(self, token: int) -> int:
        """When a token comes to stand: single bytes at once, others by rank."""
        return token if len(self.bytes_of[token]) > 1 else -1

    def fits(self, a: int, b: int) -> bool:
        """Whether the encoding of the bytes of a and b is just a and b."""
        key = a << 32 | b
        if (known := self._fits.get(key)) is None:
            if len(self._fits) >= 4 * _KEPT:
                self._fits.clear()
            self._fits[key] = known = self._undo(a, b)
        return known

    def _undo(self, a: int, b: int) -> bool:
        before = 1 << 60
        while self.ranks.get(self.bytes_of[a] + self.bytes_of[b], 1 << 60) >= before or before == 1 << 60:
            if before == 1 << 60 and self.bytes_of[a] + self.bytes_of[b] in self.ranks:
                return False
            late_a, late_b = self._made(a), self._made(b)
            if late_a < 0 and late_b < 0:
                return True
            if late_a > late_b:  # the later one is undone; of equal merges the left one came first
                before, a = late_a, self.parts(a)[1]
            else:
                before, b = late_b + 1, self.parts(b)[0]
        return False

    def extend(self, data: bytes, last: list[int], old: list[int] | None = None, shift: int = 0) -> list[int]:
        """Appends to ``last``, where ``last[i]`` is the last token of the prefix of i + 1 bytes, what is missing for ``data``.

        With ``old`` it stops calling the programme as soon as ``longest``
        positions agree with ``old[i - shift]``, and takes the rest from there.
        """
        ranks, fits, reach, same = self.ranks, self._fits, self._reach, 0
        for end in range(len(last) + 1, len(data) + 1):
            start = max(0, end - reach.get(data[end - 3 : end], 2)) if end > 2 else 0
            while (token := ranks.get(data[start:end])) is None or start and not ((ok := fits.get(last[start - 1] << 32 | token)) or ok is None and self.fits(last[start - 1], token)):
                start += 1
            last.append(token)
            if old is not None:
                at = end - 1 - shift
                same = same + 1 if 0 <= at < len(old) and old[at] == token else 0
                if same >= self.longest and len(data) - shift == len(old):
                    last.extend(old[at + 1 :])
                    return last
        return last

    def tokens(self, last: list[int]) -> list[int]:
        """Walks back from the end over the last tokens."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        return out[::-1]

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Tokens of all these pieces, as bytes of 32-bit integers.  New ones go in sorted order: each goes on from the prefix that it shares with the one before."""
        new, old = self._new, self._old
        if len(new) > _KEPT:
            self._old, self._new = old, new = new, {}
        fresh = []
        for p in pieces:
            if p not in new:
                if p in old:
                    new[p] = old[p]
                else:
                    fresh.append((p.encode("utf-8", "surrogatepass"), p))
        fresh.sort()
        data, last = b"", []
        for now, p in fresh:
            k, n = 0, min(len(data), len(now))
            while k < n and data[k] == now[k]:
                k += 1
            del last[k:]
            data = now
            new[p] = array("i", self.tokens(self.extend(now, last))).tobytes()
        return new

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [_PIECES.findall(t) for t in texts]
        known = self.learn(set().union(*split))
        return [np.frombuffer(b"".join(map(known.__getitem__, pieces)), np.int32) for pieces in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self._table.__getitem__, ids))


class Editable:
    """One piece of bytes with its prefix table, for appends and edits."""

    def __init__(self, encoder: Encoder, data: bytes = b"") -> None:
        self.encoder, self.data = encoder, data
        self.last = encoder.extend(data, [])

    def append(self, more: bytes) -> None:
        self.data += more
        self.encoder.extend(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> None:
        old = self.last
        self.data = self.data[:start] + new + self.data[end:]
        self.last = self.encoder.extend(self.data, old[:start], old, start + len(new) - end)

    def tokens(self) -> list[int]:
        return self.encoder.tokens(self.last)


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """The encoder of a rank file; each Python worker reads the file of its own installation once."""
    with open(public_tokenizers.path(vocabulary), "rb") as f:
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def _chunks(frames: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose column holds about _CHUNK characters or items, one row at least."""
    for frame in frames:
        ends = np.cumsum(pc.fill_null((pc.binary_length if pa.types.is_string(frame.column(column).type) else pc.list_value_length)(frame.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < frame.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CHUNK, "right")))
            yield frame.slice(at, end - at)
            at = end


def _append(part: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*part.columns, column], schema=part.schema.append(pa.field(name, column.type)))


def _ids(rows: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)], dtype=np.int32), np.concatenate(rows))


def encode(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """Appends ``ids``, the token ids of the whole text; null texts have none, as empty ones.

    A column of the input that is named as the new one is replaced.  Rows are
    independent, so there is no shuffle, and ties, repeated rows and empty
    tables need no rule.
    """
    df = df.drop(ids)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for part in _chunks(frames, text):
            rows = e.encode([t or "" for t in part.column(text).to_pylist()])
            yield _append(part, ids, _ids(rows))

    return df.mapInArrow(run, df.select("*", F.lit(None).cast("array<int>").alias(ids)).schema)


def decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """Appends ``decoded``, the bytes of the token ids; null lists give none."""
    df = df.drop(decoded)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for part in _chunks(frames, ids):
            column = part.column(ids)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)).tolist()
            flat = column.flatten().to_numpy(zero_copy_only=False)
            yield _append(part, decoded, pa.array([e.decode(flat[a:b].tolist()) for a, b in zip([0, *ends], ends)], pa.binary()))

    return df.mapInArrow(run, df.select("*", F.lit(None).cast("binary").alias(decoded)).schema)


def round_trip(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """``encode`` and ``decode`` in one pass, by one Python worker a task: appends ``ids``, and the bytes that they decode to."""
    df = df.drop(ids, decoded)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for part in _chunks(frames, text):
            rows = e.encode([t or "" for t in part.column(text).to_pylist()])
            yield _append(_append(part, ids, _ids(rows)), decoded, pa.array([e.decode(r.tolist()) for r in rows], pa.binary()))

    return df.mapInArrow(run, df.select("*", F.lit(None).cast("array<int>").alias(ids), F.lit(None).cast("binary").alias(decoded)).schema)
