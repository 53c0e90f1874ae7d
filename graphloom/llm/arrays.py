"""Sorted arrays as files of the shared folder, which workers map into memory."""

from __future__ import annotations

import io
import mmap
import uuid
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow.fs
import xxhash


def hashes(words: Iterable[bytes], seed: int = 0) -> np.ndarray:
    """XXH64 of each word, unsigned."""
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words, repeat(seed))), ">u8").astype(np.uint64)


def put(path: str, array: np.ndarray) -> None:
    """Write an array; a second attempt of a task replaces the file as a whole."""
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    fs.create_dir(at.rpartition("/")[0])
    part = f"{at}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(memoryview(np.ascontiguousarray(array)).cast("B") if array.size else b"")
    fs.move(part, at)


def mapped(path: str, kind: str) -> np.ndarray:
    """A read-only array over a file, in mapped memory (of a store that cannot be mapped: in the worker's); empty if there is no file."""
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    if fs.get_file_info(at).type == pyarrow.fs.FileType.NotFound:
        return np.zeros(0, kind)
    if not isinstance(fs, pyarrow.fs.LocalFileSystem):
        with fs.open_input_stream(at) as f:
            return np.frombuffer(f.read_buffer() if hasattr(f, "read_buffer") else f.read(), kind)
    with open(at, "rb") as f:
        f.seek(0, io.SEEK_END)
        return np.frombuffer(mmap.mmap(f.fileno(), 0, prot=mmap.PROT_READ), kind) if f.tell() else np.zeros(0, kind)


def put_counts(path: str, counts: np.ndarray) -> None:
    """Write counts in the least number of bytes that holds the largest of them, after eight bytes that tell it."""
    kind = np.min_scalar_type(int(counts.max())) if counts.size else np.dtype("u1")
    head = np.array([kind.itemsize], "<u8").view("u1")
    put(path, np.concatenate([head, np.ascontiguousarray(counts.astype(kind)).ravel().view("u1")]))


def mapped_counts(path: str) -> np.ndarray:
    held = mapped(path, "u1")
    return held[8:].view(f"<u{int(held[:8].view('<u8')[0])}") if len(held) else np.zeros(0, "u1")


def find(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value is in a sorted array, and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


def runs(batches) -> Iterable[tuple]:
    """``key, rows`` over batches sorted by their first column."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[0] != key:
                if rows:
                    yield key, rows
                key, rows = row[0], []
            rows.append(row[1:])
    if rows:
        yield key, rows
