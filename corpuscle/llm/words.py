"""Words of many texts at once: runs of bytes of one class, cut by array operations. A class never cuts a character, as it holds all bytes beyond ASCII or none."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut at once.
BLOCK = 8 << 20


def byte_class(digits: bool) -> np.ndarray:
    """For each byte what stands for it in a word, 0 for those outside words: letters of ASCII in lower case, all bytes beyond ASCII, digits if told."""
    table = np.zeros(256, np.uint8)
    table[128:] = np.arange(128, 256)
    low = np.arange(ord("a"), ord("z") + 1)
    table[low], table[low - 32] = low, low
    if digits:
        table[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
    return table


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, where each text's begin and the last one's end). Nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def cut(data: np.ndarray, ends: np.ndarray, table: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(all words, one text's behind another's; the number of words before each text, and of all; the byte at which each begins). A word ends where its text does."""
    mapped = table[data]
    inside = mapped != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = ends[:-1][np.diff(ends) > 0]
    first[at] = inside[at]
    places = np.flatnonzero(first)
    offsets = np.r_[np.cumsum(inside, dtype=np.int32)[places] - 1, np.count_nonzero(inside)].astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(mapped[inside])])
    return words, np.searchsorted(places, ends), places


def blocks(batches, columns: list[str], text: str):
    """Tables of about BLOCK bytes of text at most, or of one longer text, with the columns named."""
    held, room = [], BLOCK
    for b in batches:
        b = b.select(columns)
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < b.num_rows:
            before = int(ends[at] - sizes[at])
            n = int(np.searchsorted(ends[at:], before + room, side="right"))
            if not n and not held:
                n = 1
            if n:
                held.append(b.slice(at, n))
                room -= int(ends[at + n - 1]) - before
                at += n
            if at < b.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, room = [], BLOCK
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
