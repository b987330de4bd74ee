"""Vectorised text kernels over Arrow string buffers.

A batch of texts is handled as one flat byte array plus offsets.  Word
boundaries, word hashes and window hashes of *all* texts of a batch are numpy
operations on that array, so no Python code runs per document or per word.

Null texts count as empty ones everywhere in this module.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Odd multipliers of the polynomial hashes (arithmetic is modulo 2**64).
BYTE_P = 0x9E3779B97F4A7C15
WORD_P = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1

_ASCII_WS = b" \t\n\r\x0b\x0c"
#: True for the bytes that separate whitespace tokens.
WS_TABLE = np.zeros(256, bool)
WS_TABLE[list(_ASCII_WS)] = True
#: True for the bytes that separate normalised words: all ASCII but letters and digits.
PUNCT_TABLE = np.ones(256, bool)
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum():
        PUNCT_TABLE[_c] = False
#: ASCII lower-casing.
LOWER_TABLE = np.arange(256, dtype=np.uint8)
LOWER_TABLE[65:91] += 32

_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(p: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**k and p**-k for k < n, modulo 2**64."""
    have = _powers.get(p)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(p, -1, 1 << 64)
        tables = []
        for q in (p, inverse):
            t = np.empty(size, np.uint64)
            t[0] = 1
            filled = 1
            while filled < size:  # doubling: t[filled + k] = t[k] * q**filled
                t[filled : 2 * filled] = t[:filled] * np.uint64(pow(q, filled, 1 << 64))
                filled *= 2
            tables.append(t)
        have = _powers[p] = (tables[0], tables[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes and len(texts) + 1 offsets into them; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    n = len(texts)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32, n + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a batch: start and end byte of each, and first word of each text.

    ``starts``/``ends`` are byte positions in ``data``; the words of text ``i``
    are those from ``first[i]`` up to ``first[i + 1]``.
    """

    def __init__(self, texts: pa.Array, separators: np.ndarray = WS_TABLE, lower: bool = False):
        data, self.offsets = buffers(texts)
        self.data = LOWER_TABLE[data] if lower else data
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~separators[data]
        start = inside[1:-1] & ~inside[:-2]
        # a word that touches the start of a text begins there, whatever ends the text before
        heads = self.offsets[:-1][self.offsets[:-1] < n]
        start[heads] = inside[heads + 1]
        end = inside[1:-1] & ~inside[2:]
        tails = self.offsets[1:][self.offsets[1:] > 0] - 1
        end[tails] = inside[tails + 1]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def doc(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.data)
        if not len(self):
            return np.zeros(0, np.uint64)
        power, inverse = _power_tables(BYTE_P, n)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_CODES[self.data] * power, out=run[1:])
        return mix((run[self.ends] - run[self.starts]) * inverse[self.starts])


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """The hash of the words k .. k + width - 1, for each k that has so many after it."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(WORD_P, len(h))
    run = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power, out=run[1:])
    return mix((run[width:] - run[:-width]) * inverse[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[k : k + width]) for each k with a whole window, by doubling."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    have, best = 1, x
    while have * 2 <= width:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if have < width:
        best = np.minimum(best[: len(best) - (width - have)], best[width - have :])
    return best[:n]


def segments(first: np.ndarray, width: int) -> np.ndarray:
    """Of the words' windows of this width, the indices of those that lie within one text."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return np.arange(total) + shift


def rebatch(batches, rows: int = 4096, max_bytes: int = 4 << 20, text: str = "text"):
    """Cuts batches so that none has more than about max_bytes of text (a single longer text stays whole)."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        if batch.num_rows == 0:
            continue
        _, offsets = buffers(batch.column(at))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + max_bytes, "right")) - 1
            end = min(max(end, begin + 1), begin + rows, batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end
