"""Words of whole Arrow batches at once: positions by byte classes, words as one dictionary-encoded array."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Kinds of bytes: part of a word, a gap between words, a stop that no phrase goes across.
WORD, GAP, STOP = 0, 1, 2
#: Bytes of text that a task works on at a time; a longer text is a slice of its own.
BYTES = 3 << 20


def byte_kinds(gaps: bytes, stops: bytes = b"") -> np.ndarray:
    kinds = np.zeros(256, dtype=np.uint8)
    kinds[list(gaps)] = GAP
    kinds[list(stops)] = STOP
    return kinds


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers scrambled one by one."""
    x = (x ^ (x >> np.uint64(32))) * _ODD[0]
    return (x ^ (x >> np.uint64(29))) * _ODD[1]


def hashes(words: pa.Array) -> np.ndarray:
    """XXH64 of each word."""
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(w) for w in words.to_pylist()], dtype=np.uint64)


@dataclass
class Words:
    """Words in order: the text each is from, the number of stops before it in the slice, its code, and the distinct words by code."""

    text: np.ndarray
    stop: np.ndarray
    code: np.ndarray
    distinct: pa.Array

    def next_to(self, k: int = 1) -> np.ndarray:
        """Whether the word ``k`` places on is of the same text, without a stop between."""
        n = max(0, len(self.code) - k)
        return (self.text[k:] == self.text[:n]) & (self.stop[k:] == self.stop[:n])


def in_byte_slices(batches, column: int, size: int = BYTES):
    """The batches of a task, cut so that ``column`` (of strings) holds about ``size`` bytes a slice."""
    for b in batches:
        at, ends = 0, _bounds(b.column(column))
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, side="right")) - 1)
            yield b.slice(at, to - at)
            at = to


def _bounds(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    raw = texts.buffers()[1]
    if raw is None or not len(texts):
        return np.zeros(len(texts) + 1, dtype=np.int64)
    return np.frombuffer(raw, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def split(texts: pa.Array, kinds: np.ndarray) -> Words:
    """Words of UTF-8 ``texts`` (null: none), A-Z lower-cased. ``kinds`` says what each byte is; only ASCII bytes may separate."""
    if texts.null_count:
        texts = texts.fill_null("")
    ends = _bounds(texts)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, dtype=np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    ends = ends - ends[0]
    kind = kinds[_LOWER[data]]
    inside = kind == WORD
    edge = np.zeros(len(data) + 1, dtype=bool)  # a word may start or end here whatever stands beside it
    edge[ends] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, lengths = np.flatnonzero(first), np.flatnonzero(last) + 1
    lengths -= starts
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    packed = _LOWER[data[inside]]
    array = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(packed))
    coded = array.dictionary_encode()
    return Words(
        (np.searchsorted(ends, starts, side="right") - 1).astype(np.int32),
        np.searchsorted(np.flatnonzero(kind == STOP), starts).astype(np.int32),
        coded.indices.to_numpy(),
        coded.dictionary.cast(pa.string()),
    )
