"""Helpers shared by the operators that look at words inside Arrow batches.

A word is a run of bytes other than the ASCII white space 0x20 and 0x09-0x0D, as `[^\\x20\\x09-\\x0D]+` has it.
All functions work on whole texts; memory is bounded by a segment size, not by the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
MASK64 = (1 << 64) - 1
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base modulo 2**64."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 2 * len(_powers)), _BASE, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers[:n]


def hash_runs(buf: np.ndarray, starts: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """64-bit hashes of the runs of `buf` that begin at `starts` and reach to the next start."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = np.diff(starts, append=len(buf))
    first = int(starts[0])
    place = np.arange(first, len(buf)) - np.repeat(starts, lengths)
    coded = values[buf[first:]] * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(coded, starts - first))


WORD_VALUES = BYTE_VALUES.copy()
WORD_VALUES[SPACE] = 0


def word_arrays(data: bytes | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end offsets and 64-bit hashes of the words of `data`."""
    buf = np.frombuffer(data, np.uint8) if not isinstance(data, np.ndarray) else data
    blank = SPACE[buf]
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    starts, ends = edge[0::2], edge[1::2]
    if len(buf) <= SEGMENT:
        return starts, ends, hash_runs(buf, starts, WORD_VALUES)
    parts, at = [], 0
    while at < len(starts):  # segments end between words; a longer word makes a longer segment
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SEGMENT)))
        parts.append(hash_runs(buf[starts[at]:ends[to - 1]], starts[at:to] - starts[at], WORD_VALUES))
        at = to
    return starts, ends, np.concatenate(parts) if parts else np.empty(0, np.uint64)


def slices(batch: pa.RecordBatch, column: str, size: int = SEGMENT, rows: int = 4096) -> Iterator[tuple[int, list[bytes]]]:
    """Rows of a batch in order, in slices of about `size` bytes of text: first row, texts as UTF-8 (null: empty)."""
    texts = batch.column(batch.schema.get_field_index(column))
    at, held, total = 0, [], 0
    for i, text in enumerate(texts.cast(pa.large_binary())):
        value = text.as_py() or b""
        if held and (total + len(value) > size or len(held) == rows):
            yield at, held
            at, held, total = i, [], 0
        held.append(value)
        total += len(value) + 1
    if held:
        yield at, held


def sliced_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined by a line end, starts, ends and hashes of all their words, and each text's first word."""
    buf = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, ends, hashes = word_arrays(buf)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return buf, starts, ends, hashes, np.searchsorted(starts, offsets)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of every run, one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all windows of n values."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(_BASE) + hashes[i:len(hashes) - n + 1 + i]
    return mix(out)


def dealt(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order by (group, key), whatever their sizes, and (group, start, end) of the groups that occur."""
    order = np.lexsort((key, group))
    return order, occupied(group[order])


def occupied(group: np.ndarray) -> list[tuple[int, int, int]]:
    """(group, start, end) of the runs of sorted groups."""
    cuts = np.flatnonzero(np.diff(group)) + 1 if len(group) else np.empty(0, np.int64)
    starts = np.concatenate([np.zeros(min(len(group), 1), np.int64), cuts])
    ends = np.append(cuts, len(group))[:len(starts)]
    return list(zip(group[starts].tolist(), starts.tolist(), ends.tolist()))
