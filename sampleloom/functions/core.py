"""Functions of numpy arrays of any rank, outside of DataFrames."""

from __future__ import annotations

import numpy as np

from sampleloom.functions.strings import edit_counts


def _lines(src: np.ndarray, lengths: np.ndarray, dim: int):
    """A copy with ``dim`` as last axis, its lines as rows of a view, and each line's length, checked."""
    src, lengths = np.asarray(src), np.asarray(lengths)
    if not -src.ndim <= dim < src.ndim:
        raise ValueError(f"dimension {dim} of an array with {src.ndim}")
    moved = np.moveaxis(src, dim, -1).copy()
    if lengths.size * src.shape[dim] != src.size and src.size or lengths.dtype.kind not in "iu":
        raise ValueError("one whole number is needed for each line along the dimension")
    if (lengths > src.shape[dim]).any():
        raise ValueError("a length exceeds the dimension")
    return moved, moved.reshape(-1, src.shape[dim]), lengths.astype(np.int64)


def _kept(src: np.ndarray, lengths: np.ndarray, dim: int, pad: float, keep) -> tuple[np.ndarray, np.ndarray]:
    moved, lines, lengths = _lines(src, lengths, dim)
    left = np.empty(lengths.size, np.int64)
    for i, (line, n) in enumerate(zip(lines, lengths.ravel())):
        some = line[:n][keep(line[:n])]
        left[i] = len(some)
        line[: len(some)], line[len(some) :] = some, pad
    return np.ascontiguousarray(np.moveaxis(moved, -1, dim)), left.reshape(lengths.shape)


def remove(src: np.ndarray, src_length: np.ndarray, dim: int, value: float, pad: float = 0) -> tuple[np.ndarray, np.ndarray]:
    """Along ``dim`` the entries within each line's length that aren't the value, padded to the same shape; and the lengths left."""
    return _kept(src, src_length, dim, pad, lambda x: x != np.asarray(value).astype(x.dtype))


def uniq(src: np.ndarray, src_length: np.ndarray, dim: int, pad: float = 0) -> tuple[np.ndarray, np.ndarray]:
    """Along ``dim`` the entries within each line's length without consecutive repetitions, padded; and the lengths left."""
    return _kept(src, src_length, dim, pad, lambda x: np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1])))


def levenshtein(a: np.ndarray, b: np.ndarray, a_length: np.ndarray | None = None, b_length: np.ndarray | None = None) -> np.ndarray:
    """[deletions, insertions, substitutions] between two sequences, or between the rows of two 2-d arrays, within their lengths."""
    a, b = np.asarray(a), np.asarray(b)
    if a.ndim != b.ndim or a.ndim not in (1, 2) or a.dtype != b.dtype:
        raise ValueError("two arrays of one type with one or two dimensions are needed")
    flat = a.ndim == 1
    a, b = np.atleast_2d(a), np.atleast_2d(b)
    na, nb = (np.full(len(x), x.shape[1], np.int64) if n is None else np.atleast_1d(np.asarray(n)) for x, n in ((a, a_length), (b, b_length)))
    if not len(a) == len(b) == len(na) == len(nb):
        raise ValueError("as many lengths as rows are needed")
    if (na > a.shape[1]).any() or (nb > b.shape[1]).any():
        raise ValueError("a length exceeds the array")
    out = np.array([edit_counts(x[:n].tolist(), y[:m].tolist()) for x, n, y, m in zip(a, na, b, nb)], np.int64).reshape(-1, 3)
    return out[0] if flat else out
