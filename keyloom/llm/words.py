"""Word and shingle hashing over whole texts, a batch of texts at a time.

A batch is one byte buffer and the offsets of its texts.  Words are found by a table of
256 flags (which bytes belong to words), A-Z are lower-cased, and every word becomes one
64-bit hash; no word ever becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

M1, M2, M3 = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15))
S33 = np.uint64(33)


def byte_table(separators: bytes) -> np.ndarray:
    """Flags of the bytes that belong to words: all but `separators`."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: `[^\x20\x09-\x0D]+`
SPACED = byte_table(b" \t\n\v\f\r")
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing
ALNUM = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def fmix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> S33)) * M1
    h = (h ^ (h >> S33)) * M2
    return h ^ (h >> S33)


def chunks(column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `limit` bytes; a longer text is a run of its own. Null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the words, and for each text the index of its first word (one more at the end)."""
    inside = table[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    at = offsets[:-1][full]
    first[at] = inside[at]
    at = offsets[1:][full] - 1
    last[at] = inside[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, read eight bytes at a time."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = LOWER[data] if lower else data
    eights = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))
    length = ends - starts
    h = np.full(len(starts), M3)

    def take(rows, at, left):
        x = eights[at]
        cut = left < 8
        x[cut] &= (np.uint64(1) << (left[cut].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        y = (h[rows] ^ x) * M2
        h[rows] = y ^ (y >> S33)

    take(slice(None), starts, length)
    done = 8
    rows = np.flatnonzero(length > done)
    while len(rows):
        take(rows, starts[rows] + done, length[rows] - done)
        done += 8
        rows = rows[length[rows] > done]
    return fmix(h ^ length.astype(np.uint64))


def shingles(h: np.ndarray, first: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles, the word each starts at, and its text's index. With `short`, a text of fewer words (but some) is one shingle."""
    n = first[1:] - first[:-1]
    text = np.repeat(np.arange(len(n)), n)
    word = np.arange(len(h))
    acc = h * M1 + M3
    for j in range(1, k):
        m = max(0, len(h) - j)
        acc[:m] = fmix(acc[:m] * M1 + h[j:])
    keep = word + k <= first[1:][text] if len(text) else np.zeros(0, bool)
    out, at, of = acc[keep], word[keep], text[keep]
    if short and k > 1:
        few = np.flatnonzero((n > 0) & (n < k))
        if len(few):
            whole = h[first[few]] * M1 + M3
            for j in range(1, k - 1):
                more = np.flatnonzero(n[few] > j)
                whole[more] = fmix(whole[more] * M1 + h[first[few[more]] + j])
            whole = fmix(whole ^ n[few].astype(np.uint64))
            out, at, of = np.concatenate([out, whole]), np.concatenate([at, first[few]]), np.concatenate([of, few])
    return out, at, of
