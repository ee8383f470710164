"""Hashes of words and of their runs, for whole Arrow batches of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACES = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"n": 0}


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        n = max(n, 1 << 20)
        inverse = pow(_BASE, -1, 2**64)
        up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        _powers.update(n=n, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"], _powers["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row and the offsets where each begins; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end byte of every word, and for every text the place of its first word (one more at the end)."""
    inside = ~_SPACE[raw]
    fresh = np.ones(len(raw), bool)
    fresh[1:] = ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(raw))]
    fresh[cuts] = True
    begin = np.flatnonzero(inside & fresh)
    done = np.ones(len(raw), bool)
    done[:-1] = fresh[1:] | ~inside[1:]
    end = np.flatnonzero(inside & done) + 1
    return begin, end, np.searchsorted(begin, offsets)


def word_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits per word: a polynomial over random byte values, with the power of its place divided out again."""
    up, down = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:len(raw)], out=total[1:])
    return mixed((total[end] - total[begin]) * down[begin])


def shingle_sets(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, one after another, and the offset of each text's own.

    A text of fewer words than `width` has its whole sequence as its one shingle; one without words has none.
    """
    raw, offsets = text_bytes(column)
    begin, end, first = word_spans(raw, offsets)
    words = word_hashes(raw, begin, end)
    per_text = np.diff(first)
    whole = np.maximum(len(words) - width + 1, 0)
    run = np.zeros(whole, np.uint64)
    for k in range(width):
        run += words[k:k + whole] * _PLACES[k]
    text = np.repeat(np.arange(len(per_text)), per_text)
    usable = text[:whole] == text[width - 1:] if whole else np.zeros(0, bool)
    values, owner = [mixed(run[usable])], [text[:whole][usable]]
    short = np.flatnonzero((per_text > 0) & (per_text < width))
    if len(short):
        values.append(np.array([
            mixed(np.array([(words[first[t]:first[t + 1]] * _PLACES[:per_text[t]]).sum(dtype=np.uint64)
                            + np.uint64(per_text[t])]))[0] for t in short], np.uint64))
        owner.append(short)
    values, owner = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(len(per_text) + 1))


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20):
    """The batch in slices whose texts hold about `most_bytes` (one text at least), to bound memory."""
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()))
    total, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + most_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop
