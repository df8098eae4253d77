"""MinHash near-duplicate detection with the *fast similarity sketch*.

A document's set holds the distinct 4-word shingles of its lower-cased text
(A-Z only; words are runs of non-white-space).  The sketch has ``BINS``
coordinates.  In round ``i`` every shingle is hashed to a bin and a value;
a bin keeps the smallest (round, value) it sees.  From round ``BINS`` on, round
``i`` throws every shingle at bin ``i - BINS``, so that each coordinate is
filled after at most ``2 * BINS`` rounds whatever the size of the set.  Each
coordinate of two sketches agrees with probability equal to the Jaccard
similarity, with the concentration of independent draws.

``ROWS`` coordinates make a band: at a similarity of 0.8 a pair misses all
``BANDS`` bands with a probability of about 1e-7.  Four bits of every coordinate
are kept as well.  Of the ``BINS`` coordinates of such a pair, by the sketch's
concentration, fewer than ``AGREE`` agree in those bits with a probability of
about 3e-6, so pairs below that need no look at their sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SHINGLE = 4
#: Texts whose results are held together.
TOGETHER = 500
BINS = 512
ROWS = 5
BANDS = 40
BITS = 4
AGREE = 376

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 45) - 1)
_S27, _S30, _S31 = np.uint64(27), np.uint64(30), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer, applied to each element."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_CASED = _BYTES.copy()
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z


def word_hashes(data: np.ndarray, between: np.ndarray = _SPACE, prefixes: tuple[int, ...] = (), cased: bool = False) -> tuple[np.ndarray, ...]:
    """64-bit hashes of the runs of bytes outside ``between`` (a table of 256 flags), A-Z taken as a-z unless ``cased``, then of the prefixes of so many bytes of longer runs.

    A word's hash is the sum of one mixed number for each byte and its place in
    the word, cut out of running sums, so that no step loops over words.  The
    numbers of different places have nothing to do with each other, so words
    with a pattern (Thue-Morse words, which any polynomial modulo 2**64 confuses)
    are as unlike as others.
    """
    word = ~between[data]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    n = len(data)
    place = np.arange(n, dtype=np.uint64)
    place -= np.repeat(np.concatenate(([0], starts)).astype(np.uint64), np.diff(np.concatenate(([0], starts, [n]))))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix((_CASED if cased else _BYTES)[data] ^ (place * _M2)), out=sums[1:])
    out = [mix(sums[ends] - sums[starts])]
    for k in prefixes:
        of = starts[ends - starts > k]
        out.append(mix(sums[of + k] - sums[of]) + np.uint64(k))
    return tuple(out)


def shingles(data: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words of a text's UTF-8 bytes; fewer words make one shingle, none make an empty set."""
    w = word_hashes(data)[0]
    if not len(w):
        return np.empty(0, np.uint64)
    width = min(size, len(w))
    n = len(w) - width + 1
    out = w[:n] + np.uint64(width)
    for k in range(1, width):
        out = (out ^ (out >> _S31)) * _M1 + w[k : n + k]
    out = mix(out)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text, as they lie in the column; none for null."""
    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return (data[a:b] for a, b in zip(ends, ends[1:]))


def sketch(items: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The fast similarity sketch of a set of 64-bit hashes that isn't empty."""
    out = np.zeros(bins, np.uint64)
    empty = np.ones(bins, bool)
    edges = np.arange(bins, dtype=np.uint64) << np.uint64(55)
    done = 0
    while empty.any() and done < 2 * bins:
        rounds = np.arange(done, min(2 * bins, done + max(1, -(-2 * bins // len(items)))), dtype=np.uint64)
        h = mix(items[None, :] + (rounds[:, None] + np.uint64(1)) * _GOLD)
        where = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        late = rounds >= bins
        if late.any():
            where[late] = (rounds[late] - np.uint64(bins))[:, None]
        value = ((where << np.uint64(55)) | (rounds[:, None] << np.uint64(45)) | (h & _LOW)).ravel()
        value.sort()
        at = np.searchsorted(value, edges)
        first = value[np.minimum(at, len(value) - 1)]
        fill = empty & (at < len(value)) & ((first >> np.uint64(55)) == (edges >> np.uint64(55)))
        out[fill] = first[fill]
        empty &= ~fill
        done += len(rounds)
    return out


def bands(sk: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, the band's number included."""
    parts = sk[: BANDS * ROWS].reshape(-1, ROWS)
    out = np.arange(len(parts), dtype=np.uint64) + np.uint64(1)
    for k in range(ROWS):
        out = (out ^ (out >> _S31)) * _M1 + parts[:, k]
    return mix(out).view(np.int64)


def planes(sk: np.ndarray) -> np.ndarray:
    """The lowest BITS bits of the coordinates: for each bit, BINS / 64 words of 64 coordinates."""
    bits = (sk[None, :] >> np.arange(BITS, dtype=np.uint64)[:, None]).astype(np.uint8) & 1
    return np.packbits(bits, axis=1).view(np.int64).ravel()


def set_key(items: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(items.tobytes())


def _parts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of ``TOGETHER`` rows at most, which bound what is held of the results."""
    for frame in frames:
        yield from (frame.slice(at, TOGETHER) for at in range(0, frame.num_rows, TOGETHER))


def sketch_batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, n_shingles, set_key, bands, planes); the last three are null for empty sets."""
    for part in _parts(frames):
        n, keys, rows, bits = [], [], [], []
        for data in texts(part.column("text")):
            items = shingles(data)
            n.append(len(items))
            keys.append(set_key(items) if len(items) else None)
            sk = sketch(items) if len(items) else None
            rows.append(None if sk is None else bands(sk))
            bits.append(None if sk is None else planes(sk))
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, longs), pa.array(bits, longs)], ["doc_id", "n_shingles", "set_key", "bands", "planes"])


def shingle_batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, items), the whole shingle sets."""
    for part in _parts(frames):
        items = [shingles(data).view(np.int64) for data in texts(part.column("text"))]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(items, pa.list_(pa.int64()))], ["doc_id", "items"])
