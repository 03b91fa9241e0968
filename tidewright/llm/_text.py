"""Vectorised word hashing over Arrow string columns.

Words are the maximal runs of bytes outside ``\\x20\\x09-\\x0D``, compared after
lower-casing A-Z.  A word's hash is chained over its eight-byte pieces, each
mixed by a bijection with how many bytes are left; words are hashed together, a piece of
all at a time, so that no Python code runs per word.  (A polynomial modulo 2^64
would not do: some pairs of words collide for every base.)
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: Bytes of text hashed at a time, rows at most; one longer text is a block of its own, whose words are found in windows.
BLOCK_BYTES, BLOCK_ROWS, WINDOW = 1 << 19, 8192, 4 << 20
#: Words of more bytes are hashed one by one.
LONG = 256

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = _FOLD[97:123]
_MASKS = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], U)
_SEED = U(0xD6E8FEB86659FD93)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + U(0x9E3779B97F4A7C15)
    for shift, odd in ((U(30), U(0xBF58476D1CE4E5B9)), (U(27), U(0x94D049BB133111EB))):
        x ^= x >> shift
        x *= odd
    x ^= x >> U(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets (one more than its rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    buffers, n, at = column.buffers(), len(column), column.offset
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, at * 8)
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(buffers[2], np.uint8, last - first, first) if last > first else np.empty(0, np.uint8)
    return data, offsets - first


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES, rows: int = BLOCK_ROWS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes each, ``rows`` rows at most."""
    n, row = len(offsets) - 1, 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(max(end, row + 1), row + rows, n)
        yield row, end
        row = end


def spans(solid, size: int, offsets: np.ndarray, alone=None) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of a block; no word runs over the edge of a text.

    ``solid(a, b)`` tells which of the places a to b belong to words, and
    ``alone(a, b)`` which of those are words by themselves.
    """
    starts, ends = [], []
    for a in range(0, size, WINDOW):
        b = min(a + WINDOW, size)
        low, high = max(a - 1, 0), min(b + 1, size)
        inside = solid(low, high)
        cut = np.zeros(high - low + 1, bool)
        cut[offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, high, "right")] - low] = True
        if alone is not None:
            single = alone(low, high)
            cut[:-1] |= single
            cut[1:] |= single
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1] | cut[1:-1]
        end[:-1] &= ~inside[1:] | cut[1:-1]
        starts.append(np.flatnonzero(start[a - low : b - low]) + a)
        ends.append(np.flatnonzero(end[a - low : b - low]) + a + 1)
    none = [np.empty(0, np.int64)]
    return np.concatenate(starts or none), np.concatenate(ends or none)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word."""
    return spans(lambda a, b: ~_SPACE[data[a:b]], len(data), offsets)


def fold(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _FOLD[data]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans of one block, none of them empty, equal for equal bytes wherever they stand."""
    if not len(starts):
        return np.empty(0, U)
    padded = np.concatenate([data.view(np.uint8), np.zeros(8, np.uint8)])
    pieces = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    size = ends - starts
    out = mix64(mix64(np.arange(9, dtype=U) ^ _SEED)[np.minimum(size, 8)] ^ (pieces[starts] & _MASKS[np.minimum(size, 8)]))
    live = np.arange(len(starts))
    for k in range(8, min(int(size.max()), LONG), 8):
        live = live[size[live] > k]
        left = np.minimum(size[live] - k, 9)
        out[live] = mix64((out[live] + left.astype(U)) ^ (pieces[starts[live] + k] & _MASKS[np.minimum(left, 8)]))
    for k in np.flatnonzero(size > LONG):
        out[k] = xxhash.xxh3_64_intdigest(padded[starts[k] : ends[k]])
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a block in order, and the index of each text's first word (one more than texts)."""
    starts, ends = word_spans(data, offsets)
    return span_hashes(fold(data), starts, ends), np.searchsorted(starts, offsets)


#: Scripts without spaces between words, by code points: Thai and Lao, Tibetan, Burmese, Khmer, kana, Han.  Each character is a word.
_UNSPACED = ((0x0E00, 0x0F00), (0x0F00, 0x1000), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3040, 0x3100), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x40000))
#: Ranges whose characters are all letters without case.
_UNCASED = ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x323B0))
ALONE = np.uint32(1 << 31)


@cache
def letter_table() -> np.ndarray:
    """For each code point 0 if it parts words, or itself in lower case, with ALONE set where it is a word by itself.

    Letters, digits and the marks upon them make words, in every script.
    """
    table = np.zeros(0x110000, np.uint32)
    skipped = np.zeros(0x20000, bool)
    for a, b in _UNCASED:
        table[a:b] = np.arange(a, b)
        skipped[a:b] = True
    skipped[0xD7A4:0xF900] = True  # surrogates and private use
    for code in np.flatnonzero(~skipped).tolist():
        c = chr(code)
        if c.isalnum() or unicodedata.category(c)[0] == "M":
            low = c.casefold()
            low = low if len(low) == 1 else c.lower()
            table[code] = ord(low) if len(low) == 1 else code
    for a, b in _UNSPACED:
        part = table[a:b]
        part[part > 0] |= ALONE
    return table


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a block's texts, composed (NFC), and where each text begins."""
    raw = data.tobytes()
    try:
        whole = raw.decode("utf-8")
    except UnicodeDecodeError:
        whole = None
    if whole is None or not (whole.isascii() or unicodedata.is_normalized("NFC", whole)):
        texts = [unicodedata.normalize("NFC", raw[a:b].decode("utf-8", "replace")) for a, b in zip(offsets, offsets[1:])]  # noqa: B905
        whole, places = "".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    elif whole.isascii():
        places = offsets
    else:
        full = np.flatnonzero(np.diff(offsets))
        sizes = np.zeros(len(offsets) - 1, np.int64)
        if len(full):
            sizes[full] = np.add.reduceat((data & 0xC0) != 0x80, offsets[full], dtype=np.int64)
        places = np.concatenate([[0], np.cumsum(sizes)])
    return np.frombuffer(whole.encode("utf-32-le"), np.uint32) if not whole.isascii() else data, places


def letter_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like word_hashes() for words of letters and digits of any script and case; characters of unspaced scripts are words."""
    codes, places = code_points(data, offsets)
    codes = letter_table()[codes]
    starts, ends = spans(lambda a, b: codes[a:b] > 0, len(codes), places, lambda a, b: codes[a:b] >= ALONE)
    return span_hashes(codes.astype("<u4"), starts * 4, ends * 4), np.searchsorted(starts, places)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text of a block.

    A text of fewer than k words, but one at least, has its whole sequence as
    its one shingle; a text without words has none.  Returns the hashes of all
    texts in order and the bounds of each text's set.
    """
    words, first = word_hashes(data, offsets)
    n = np.diff(first)
    rows = len(n)
    if not len(words):
        return np.empty(0, U), np.zeros(rows + 1, np.int64)
    total = len(words)
    rolled = np.zeros(total, U)
    for j in range(k):
        step = mix64(np.array([j + 1], U))[0] | U(1)
        rolled[: total - j if j else total] += words[j:] * step
    doc = np.repeat(np.arange(rows), n)
    place = np.arange(total) - np.repeat(first[:-1], n)
    keep = place <= np.repeat(n, n) - k
    shingles, owner = mix64(rolled[keep]), doc[keep]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        alone = np.zeros(len(short), U)
        for at, row in enumerate(short):
            sequence = words[first[row] : first[row + 1]]
            steps = mix64(np.arange(1, len(sequence) + 1, dtype=U)) | U(1)
            alone[at] = mix64(np.array([(int((sequence * steps).sum(dtype=U)) + len(sequence) * 0xD6E8FEB86659FD93) % 2**64], U))[0]
        shingles, owner = np.concatenate([shingles, alone]), np.concatenate([owner, short])
        shingles = shingles[np.argsort(owner, kind="stable")]
    sizes = np.maximum(n - k + 1, (n > 0).astype(n.dtype))
    ends = np.cumsum(sizes)
    kept, bounds = [], np.zeros(rows + 1, np.int64)
    for row in range(rows):
        own = np.sort(shingles[ends[row] - sizes[row] : ends[row]])
        if len(own) > 1:
            new = np.empty(len(own), bool)
            new[0] = True
            np.not_equal(own[1:], own[:-1], out=new[1:])
            own = own[new]
        kept.append(own)
        bounds[row + 1] = bounds[row] + len(own)
    return np.concatenate(kept) if kept else np.empty(0, U), bounds
