"""Word bounds, rolling hashes and windows of least hash over Arrow text batches, in numpy.

All functions work on the UTF-8 bytes of many documents at once. A hash of a stretch
depends on its content alone, so equal stretches of different documents agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
POSITION_BITS = 31
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD1342543DE82EF95}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its rows; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0]: bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer text is alone in its range."""
    n, at = len(bounds) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        end = min(end, n)
        yield at, end
        at = end


def documents(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of slices of a batch."""
    raw, bounds = text_buffers(batch.column(text))
    for a, b in slices(bounds):
        yield a, b, raw[bounds[a]: bounds[b]], bounds[a: b + 1] - bounds[a]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    held = _powers.get(kind)
    if held is None or len(held[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        base = _BASES[kind]
        inverse = pow(base, -1, 1 << 64)
        held = tuple(np.cumprod(np.append(np.uint64(1), np.full(size - 1, b, np.uint64)), dtype=np.uint64) for b in (base, inverse))
        if size <= 4 * SLICE_BYTES:
            _powers[kind] = held
    return held


class Rolling:
    """Hashes of any stretch [start, end) of a sequence of 64-bit values, from prefix sums."""

    def __init__(self, values: np.ndarray, kind: str):
        n = len(values)
        up, self.down = _power(kind, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, n: int) -> np.ndarray:
        """Hashes of all stretches of n values."""
        count = len(self.sums) - n
        if count <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[n:] - self.sums[:count]) * self.down[:count])


def byte_rolling(raw: np.ndarray) -> Rolling:
    return Rolling(_BYTE[raw], "byte")


def word_bounds(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words ``[^\\x20\\x09-\\x0D]+`` and the number of words before each row."""
    inside = ~_SPACE[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return byte_rolling(raw).stretch(starts, ends)


def sliding_first_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its least one, the first of equals.

    Values are compared by their upper bits, with the place in the lower ones; what
    is chosen depends on the content of the window alone.
    """
    n = len(values)
    count = n - width + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << POSITION_BITS) - 1)
    blocks = -(-n // width)
    keys = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    keys[:n] = (values & ~low) | np.arange(n, dtype=np.uint64)
    keys = keys.reshape(blocks, width)
    after = np.minimum.accumulate(keys[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    upto = np.minimum.accumulate(keys, axis=1).reshape(-1)
    return (np.minimum(after[:count], upto[width - 1: width - 1 + count]) & low).astype(np.int64)


def anchored_runs(hashes: np.ndarray, width: int, bounds: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows that share their least gram: (row, first window, windows, place of the gram).

    ``bounds`` are the item bounds of the rows, ``span`` the items of one window. Each
    window of each row is in one run.
    """
    places = sliding_first_min(hashes, width)
    n = bounds[-1] - span + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    places = places[:n]
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
    ok = np.arange(n) + span <= bounds[row + 1]
    at = np.flatnonzero(ok)
    if not len(at):
        return at, at, at, at
    change = np.ones(len(at), bool)
    change[1:] = (places[at[1:]] != places[at[:-1]]) | (row[at[1:]] != row[at[:-1]])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(at)))
    lead = at[first]
    return row[lead], lead, count, places[lead]
