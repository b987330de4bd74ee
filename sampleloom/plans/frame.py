"""The chainable facade: buffers with an order and random access, streams without.

A :class:`Buffer` is a DataFrame with the contiguous column ``__idx``; a
:class:`Stream` may have it.  Every method returns a new object around a new
lazy plan: nothing runs until an action, and iterating one object never moves another.  Each
sample operation has a twin with the suffix ``_if`` whose first argument is a
plain condition: false leaves the object as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampleloom import state
from sampleloom.functions import arrays, images, strings, tokenize
from sampleloom.operators import batching, columns, order, windows
from sampleloom.sources import media, tar, text
from sampleloom.types import INDEX, TENSOR, untensor


def _value(v: Any, kind) -> Any:
    if kind == TENSOR:
        return untensor(v)
    return bytes(v) if isinstance(v, bytearray) else np.asarray(v) if isinstance(v, list) else v


class Dataset:
    """What buffers and streams have in common."""

    def __init__(self, df: DataFrame):
        self.df = df

    def _with(self, df: DataFrame):
        return type(self)(df)

    def _image(self, key: str, f: Callable, output_key: str = "", seed: int | None = None):
        return self._with(images.image_op(self.df, key, f, output_key, seed))

    # keys and rows
    def filter_key(self, key: str, remove: bool = False):
        return self._with(columns.filter_key(self.df, key, remove))

    def rename_key(self, key: str, output_key: str):
        return self._with(columns.rename_key(self.df, key, output_key))

    def key_transform(self, key: str, func: Callable, output_key: str = "", return_type=None):
        return self._with(columns.key_transform(self.df, key, func, output_key, return_type))

    def sample_transform(self, func: Callable[[dict], dict], schema=None):
        return self._with(columns.sample_transform(self.df, func, schema))

    def shape(self, key: str, output_key: str, dim: int | None = None):
        return self._with(arrays.shape(self.df, key, output_key, dim))

    def filter_by_shape(self, key: str, dim: int, low: int = -1, high: int = -1):
        return self._filtered(arrays.filter_by_shape(self.df, key, dim, low, high))

    def where(self, predicate: Column):
        """Rows for which the predicate holds."""
        return self._filtered(self.df.where(predicate))

    def _filtered(self, df: DataFrame):
        return self._with(df)

    # arrays
    def pad(self, key: str, dim: int, lpad: int, rpad: int, pad_value: float = 0, output_key: str = ""):
        return self._with(arrays.pad(self.df, key, dim, lpad, rpad, pad_value, output_key))

    def pad_to_multiple(self, key: str, dim: int, pad_multiple: int, pad_value: float = 0, output_key: str = ""):
        return self._with(arrays.pad_to_multiple(self.df, key, dim, pad_multiple, pad_value, output_key))

    def pad_to_size(self, key: str, dim: int, size, pad_value: float = 0, output_key: str = ""):
        return self._with(arrays.pad_to_size(self.df, key, dim, size, pad_value, output_key))

    def slice(self, ikey: str, dims, starts, ends, output_key: str = ""):
        return self._with(arrays.slice_(self.df, ikey, dims, starts, ends, output_key))

    def random_slice(self, ikey: str, dims, sizes, output_key: str = "", seed: int | None = None):
        return self._with(arrays.random_slice(self.df, ikey, dims, sizes, output_key, state.pick(seed)))

    def squeeze(self, key: str, dim=None, output_key: str = ""):
        return self._with(arrays.squeeze(self.df, key, dim, output_key))

    def shard(self, key: str, num_shards: int, output_key: str = ""):
        return self._with(arrays.shard(self.df, key, num_shards, output_key))

    def remove_value(self, key: str, size_key: str, dim: int, value: float, pad: float = 0):
        return self._with(arrays.remove_value(self.df, key, size_key, dim, value, pad))

    # bytes and tokens
    def replace(self, key: str, old: str, replacement: str, count: int = -1, output_key: str = ""):
        return self._with(strings.replace(self.df, key, old, replacement, count, output_key))

    def replace_bytes(self, ikey: str, byte_map: Sequence[str], output_key: str = ""):
        return self._with(strings.replace_bytes(self.df, ikey, byte_map, output_key))

    def tokenize(self, key: str, trie, mode: str = tokenize.SHORTEST, ignore_unk: bool = False, trie_key_scores=(), output_key: str = "", seed: int | None = None):
        return self._with(tokenize.tokenize(self.df, key, trie, mode, ignore_unk, trie_key_scores, output_key, state.pick(seed)))

    def tokenize_bpe(self, key: str, symbols, merges, output_key: str = ""):
        return self._with(tokenize.tokenize_bpe(self.df, key, symbols, merges, output_key))

    # files and media
    def load_file(self, key: str, prefix: str = "", output_key: str = ""):
        return self._with(media.load_file(self.df, key, prefix, output_key))

    def load_numpy(self, key: str, prefix: str = "", from_memory: bool = False, output_key: str = ""):
        return self._with(media.load_numpy(self.df, key, prefix, from_memory, output_key))

    def load_image(self, key: str, prefix: str = "", info: bool = False, format: str = "RGB", from_memory: bool = False, output_key: str = ""):
        return self._with(media.load_image(self.df, key, prefix, info, from_memory, output_key))

    def load_audio(self, key: str, **options):
        return self._with(media.load_audio(self.df, key, **options))

    def resample_audio(self, key: str, sample_rate: int, input_sample_rate: int = 0, info_key: str = "", resampling_quality: str = "linear", output_key: str = ""):
        return self._with(media.resample_audio(self.df, key, sample_rate, input_sample_rate, info_key, resampling_quality, output_key))

    def load_video(self, key: str, **options):
        return self._with(media.load_video(self.df, key, **options))

    def read_from_tar(self, tarkey: str, ikey: str, okey: str, prefix: str = "", tar_prefix: str = "", from_key: bool = False, nested: bool = False, tars=None):
        return self._with(tar.read_from_tar(self.df, tarkey, ikey, okey, prefix, tar_prefix, from_key, nested, tars))

    def save_image(self, key: str, filename_key: str, prefix: str = "", filenamePrefix: str = ""):
        """Writes the images now and returns the same samples."""
        media.save_image(self.df, key, filename_key, prefix, filenamePrefix)
        return self

    # images
    def image_center_crop(self, key: str, w: int, h: int, output_key: str = ""):
        return self._image(key, lambda x: images.center_crop(x, w, h), output_key)

    def image_channel_reduction(self, key: str, preset: str = "default", output_key: str = ""):
        return self._image(key, lambda x: images.channel_reduction(x, preset), output_key)

    def image_random_area_crop(self, key: str, area_range, aspect_ratio_range, num_trial: int = 10, output_key: str = "", seed: int | None = None):
        return self._image(key, lambda x, r: images.random_area_crop(x, area_range, aspect_ratio_range, r, num_trial), output_key, state.pick(seed))

    def image_random_crop(self, key: str, w: int, h: int, output_key: str = "", seed: int | None = None):
        return self._image(key, lambda x, r: images.random_crop(x, w, h, r), output_key, state.pick(seed))

    def image_random_h_flip(self, key: str, prob: float, output_key: str = "", seed: int | None = None):
        return self._image(key, lambda x, r: images.h_flip(x) if r.random() <= prob else x, output_key, state.pick(seed))

    def image_resize(self, key: str, w: int, h: int, output_key: str = ""):
        return self._image(key, lambda x: images.resize(x, w, h), output_key)

    def image_resize_smallest_side(self, key: str, size: int, output_key: str = ""):
        return self._image(key, lambda x: images.resize_smallest_side(x, size), output_key)

    def image_rotate(self, key: str, angle: float, crop: bool = False, output_key: str = ""):
        return self._image(key, lambda x: images.rotate(x, angle, crop), output_key)

    # iteration
    def __iter__(self) -> Iterator[dict]:
        """Samples as dicts of numbers, bytes and numpy arrays, in order where there is one."""
        df = self.df.orderBy(INDEX) if INDEX in self.df.columns else self.df
        keys = [c for c in df.columns if c != INDEX]
        kinds = {k: df.schema[k].dataType for k in keys}
        for row in df.select(*keys).toLocalIterator(prefetchPartitions=True):
            yield {k: _value(row[k], kinds[k]) for k in keys}

    _reader: Iterator[dict] | None = None

    def __next__(self) -> dict:
        """The next sample of this object's own reading, which begins with the first call and again after ``reset``."""
        if self._reader is None:
            self._reader = iter(self)
        return next(self._reader)

    def next(self) -> dict:
        """As ``__next__``, but an empty dict after the last sample."""
        try:
            return self.__next__()
        except StopIteration:
            return {}

    def __call__(self) -> dict:
        return self.next()

    def iterate(self, repeat: int = 0) -> Iterator[dict]:
        """``repeat + 1`` passes, or endless ones where negative."""
        n = 0
        while repeat < 0 or n <= repeat:
            yield from self
            n += 1


_SAMPLE_OPS = """filter_by_shape filter_key image_center_crop image_channel_reduction image_random_area_crop image_random_crop image_random_h_flip
image_resize image_resize_smallest_side image_rotate key_transform sample_transform load_audio resample_audio load_file load_image load_numpy load_video
pad pad_to_multiple pad_to_size random_slice read_from_tar remove_value rename_key replace replace_bytes save_image shape shard slice squeeze tokenize tokenize_bpe""".split()


def _twins(cls, names: Sequence[str]) -> None:
    for name in names:
        op = getattr(cls, name)

        def conditional(self, cond: bool, *args, _name=name, **kwargs):
            return getattr(self, _name)(*args, **kwargs) if cond else self

        conditional.__name__, conditional.__doc__ = f"{name}_if", f"``{name}`` where cond is true, else the same object.\n\n{op.__doc__ or ''}"
        setattr(cls, f"{name}_if", conditional)


_twins(Dataset, _SAMPLE_OPS)


class Buffer(Dataset):
    """A finite table in order.  With ``strict`` an operation that drops rows raises, as positions would change."""

    def __init__(self, df: DataFrame, *order_by, strict: bool = False):
        super().__init__(order.with_index(df, *order_by) if order_by else df)
        if INDEX not in self.df.columns:
            raise ValueError("a buffer needs an order: name the keys that give it")
        self.strict = strict

    def _with(self, df: DataFrame):
        return Buffer(df, strict=self.strict)

    def _filtered(self, df: DataFrame):
        if self.strict:
            raise ValueError("a strict buffer can't drop samples: turn it into a stream first")
        return self._with(order.renumbered(df))

    def __len__(self) -> int:
        return self.df.count()

    size = __len__

    def __getitem__(self, i: int) -> dict:
        n = len(self)
        at = i + n if i < 0 else i
        if not 0 <= at < n:
            raise IndexError(f"{i} of {n}")
        return next(iter(Stream(self.df.where(F.col(INDEX) == at))))

    def __repr__(self) -> str:
        return f"Buffer(size={len(self)}, keys={{{', '.join(c for c in self.df.columns if c != INDEX)}}})"

    def append(self, other: Buffer) -> Buffer:
        return self._with(order.append(self.df, other.df))

    def partition(self, num_partitions: int, partition: int) -> Buffer:
        return self._with(order.partition(self.df, num_partitions, partition))

    def perm(self, indices: Sequence[int]) -> Buffer:
        return self._with(order.perm(self.df, indices))

    def shuffle(self, seed: int | None = None) -> Buffer:
        return self._with(order.shuffle(self.df, state.pick(seed)))

    def batch(self, batch_size, pad: Mapping[str, float] | float = 0, dim: Mapping[str, int] | None = None) -> Buffer:
        return self._with(batching.batch(self.df, batch_size, pad, dim))

    def dynamic_batch(self, key: str, size_buffer: Buffer | None = None, min_data_size: int = -1, max_data_size: int = -1, pad=0, dim=None, drop_outliers: bool = False) -> Buffer:
        return self._with(batching.dynamic_batch(self.df, key, min_data_size, max_data_size, pad, dim, drop_outliers, size_df=size_buffer.df if size_buffer else None))

    def ordered_prefetch(self, prefetch_size: int = 1, num_thread: int = 1) -> Stream:
        """Tasks run ahead of the reader anyway: the rows in order."""
        return Stream(self.df)

    def to_stream(self) -> Stream:
        return Stream(self.df)

    def concretize(self) -> Buffer:
        """Evaluated once and kept; lost parts are computed again."""
        df = self.df.persist()
        df.count()
        return self._with(df)


class Stream(Dataset):
    """Rows that are read once, forward."""

    def batch(self, batch_size: int, pad: Mapping[str, float] | float = 0, dim: Mapping[str, int] | None = None) -> Stream:
        return self._with(batching.batch(self.df, batch_size, pad, dim))

    def dynamic_batch(self, buffer_size: int, key: str, *, min_data_size: int = -1, max_data_size: int = -1, pad=0, dim=None, shuffle: bool = False, drop_outliers: bool = False, max_skipped_samples: int = 1000, num_threads: int = 1, seed: int | None = None) -> Stream:
        return self._with(batching.dynamic_batch(self.df, key, min_data_size, max_data_size, pad, dim, drop_outliers, buffer_size, shuffle, state.pick(seed), max_skipped_samples))

    def buffered(self, buffer_size: int, on_refill: Callable | None = None, num_threads: int = 1, schema=None) -> Stream:
        return self._with(batching.buffered(self.df, buffer_size, on_refill, schema))

    def csv_reader_from_key(self, key: str, columns: list[str], sep: str = ",", quote: str = '"', from_memory: bool = False, local_prefix: str = "") -> Stream:
        return self._with(text.csv_reader_from_key(self.df, key, columns, sep, quote, from_memory, local_prefix))

    def line_reader_from_key(self, key: str, dst_key: str, from_memory: bool = True, local_prefix: str = "", keep_keys: Sequence[str] = (), unzip: bool = False) -> Stream:
        df = self.df if from_memory else media.load_file(self.df, key, local_prefix)
        df = columns.key_transform(df, key, text.decompress, return_type="binary") if unzip else df
        return self._with(strings.line_reader_from_key(df, key, dst_key, keep_keys))

    def partition(self, num_partitions: int, partition: int) -> Stream:
        return self._with(order.partition(self.df, num_partitions, partition))

    def compose(self, func: Callable[[dict], Iterable[dict]], schema) -> Stream:
        """All samples that ``func`` makes from each sample, in one stream."""
        return self._with(columns.compose(self.df, func, schema))

    def prefetch(self, prefetch_size: int, num_threads: int) -> Stream:
        """Tasks run ahead of the reader anyway: the same rows."""
        return self

    def repeat(self, num_time: int) -> Stream:
        return self._with(order.repeat(self.df, num_time))

    def shuffle(self, buffer_size: int, seed: int | None = None) -> Stream:
        return self._with(order.stream_shuffle(self.df, buffer_size, state.pick(seed)))

    def sliding_window(self, key: str, size: int, stride: int, dim: int = -1, index_key: str = "") -> Stream:
        """The windows get an index with gaps; ``to_buffer`` numbers them."""
        return self._with(windows.sliding_window(self.df, key, size, stride, dim, index_key))

    def reset(self) -> Stream:
        """``next`` begins again; each iteration reads from the start anyway."""
        self._reader = None
        return self

    def __repr__(self) -> str:
        return f"Stream(keys={{{', '.join(c for c in self.df.columns if c != INDEX)}}})"

    def to_buffer(self, *order_by) -> Buffer:
        if order_by:
            return Buffer(self.df, *order_by)
        if INDEX not in self.df.columns:
            raise ValueError("a buffer needs an order: name the keys that give it")
        return Buffer(order.renumbered(self.df))


_twins(Buffer, ["append", "batch", "dynamic_batch", "partition", "perm", "shuffle", "ordered_prefetch"])
_twins(Stream, ["batch", "buffered", "dynamic_batch", "line_reader_from_key", "csv_reader_from_key", "partition", "prefetch", "repeat", "shuffle", "sliding_window"])
