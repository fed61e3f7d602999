"""What the training-data operators share: Arrow text buffers, word and window hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from ..session import scratch, stored  # noqa: F401 - the operators take both from here

#: Bytes of text that are hashed at once; a longer single text comes in pieces of this size.
BLOCK_BYTES = 1 << 18


# ---------------------------------------------------------------- Arrow text

def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column end to end, and the n + 1 offsets of its rows. Null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    wide = column.cast(pa.large_string())
    if wide.null_count:
        wide = wide.fill_null("")
    n = len(wide)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = wide.buffers()
    offs = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def row_blocks(offs: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of about limit bytes (BLOCK_BYTES by default); a longer row stands alone."""
    i, n, limit = 0, len(offs) - 1, limit or BLOCK_BYTES
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


# ---------------------------------------------------------------- hashes

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 64, 256, dtype=np.uint64)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0.. and base^-0.., n + 1 of each at least, modulo 2^64."""
    have = _powers.get(0)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 2 * BLOCK_BYTES + 4096)
        up, down = np.full(size, _BASE), np.full(size, _BASE_INV)
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size <= 1 << 22:
            _powers[0] = have
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte value times base^position, for hashes of rolling windows; regular texts may collide in them, so they only deal out work."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values()[data] * powers(len(data))[0][: len(data)], dtype=np.uint64, out=out[1:])
    return out


#: Spans of up to so many bytes are hashed together, eight bytes at a step; longer ones each by BLAKE2b.
_SHORT = 512
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)
_STEP = _U(0xD6E8FEB86659FD93)


def _long_hash(state: hashlib.blake2b) -> int:
    return int.from_bytes(state.digest(), "little")


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand.

    Every eight bytes pass through a mixing that is not linear, so texts of a regular build, which cancel out
    in a polynomial modulo 2^64, do not meet here. Two spans of one length up to eight bytes never do.
    """
    size = end - start
    out = mixed(size.astype(np.uint64) * _STEP + _U(0x2545F4914F6CDD1D))
    if not len(out):
        return out
    long = np.flatnonzero(size > _SHORT)
    short = np.flatnonzero((size > 0) & (size <= _SHORT)) if len(long) or (size == 0).any() else slice(None)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    at, left, h, live = start[short], size[short], out[short], None
    while len(at):
        step = mixed(h ^ (lanes[at] & _MASKS[np.minimum(left, 8)])) + _STEP
        if live is None:
            out[short] = step
            live = np.arange(len(out))[short]
        else:
            out[live] = step
        more = left > 8
        at, left, h, live = at[more] + 8, left[more] - 8, step[more], live[more]
    for i in long.tolist():
        out[i] = _long_hash(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8))
    return out


class OpenSpan:
    """Hashes of spans of a text that comes in pieces: what a piece leaves open goes on in the next one.

    The hash of a span is that of span_hashes, however many pieces it runs over.
    """

    def __init__(self) -> None:
        self.state: hashlib.blake2b | None = None
        self.head, self.size = b"", 0

    def _take(self, data: np.ndarray) -> None:
        if self.state is None:
            self.state, self.head, self.size = hashlib.blake2b(digest_size=8), b"", 0
        self.state.update(data)
        self.size += len(data)
        if len(self.head) < _SHORT:
            self.head += data[: _SHORT - len(self.head)].tobytes()

    def feed(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, goes_on: bool, stays_open: bool) -> np.ndarray:
        """Hashes of the spans that are complete now. goes_on: the first one continues the open span; stays_open: the last one may go on."""
        closed = []
        if self.state is not None:
            if goes_on:
                self._take(data[start[0] : end[0]])
                start, end = start[1:], end[1:]
                if stays_open and not len(start):
                    return np.zeros(0, np.uint64)
            closed.append(self.close())
        if stays_open:
            self._take(data[start[-1] : end[-1]])
            start, end = start[:-1], end[:-1]
        return np.concatenate((*closed, span_hashes(data, start, end)))

    def close(self) -> np.ndarray:
        """The hash of the span that is still open, if one is."""
        if self.state is None:
            return np.zeros(0, np.uint64)
        if self.size <= _SHORT:
            out = span_hashes(np.frombuffer(self.head, np.uint8), np.array([0]), np.array([self.size]))
        else:
            out = np.array([_long_hash(self.state)], np.uint64)
        self.state = None
        return out


# ---------------------------------------------------------------- words

#: White space of the contracts, 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space (or other bytes marked in space), none across rows, and n + 1 word offsets of the rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    before &= ~edge[:-1]
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text, which may be very long: beside them only the arrays of a piece are held."""
    out, spans = [], OpenSpan()
    for at in range(0, len(data), BLOCK_BYTES):
        piece = data[at : at + BLOCK_BYTES]
        starts, ends, _ = word_spans(piece, np.array([0, len(piece)]))
        if len(starts):
            out.append(spans.feed(piece, starts, ends, bool(starts[0] == 0), bool(ends[-1] == len(piece))))
        else:
            out.append(spans.close())
    return np.concatenate((*out, spans.close()))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each run of width word hashes; across rows too, so slice by row."""
    n = max(len(words) - width + 1, 0)
    out = np.empty(n, np.uint64)
    for i in range(0, n, 1 << 16):
        k = min(n, i + (1 << 16))
        total = words[i:k].copy()
        for j in range(1, width):
            total += words[i + j : k + j] * _U(pow(0xD1342543DE82EF95, j, 1 << 64))
        out[i:k] = mixed(total)
    return out


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted, each once; the argument is sorted in place."""
    hashes.sort()
    return hashes[np.append(True, hashes[1:] != hashes[:-1])] if len(hashes) else hashes


def sequence_hash(words: np.ndarray) -> np.uint64:
    """Hash of a short whole word sequence, apart from those of windows."""
    h = 0xA24BAED4963EE407 + len(words)
    for w in words.tolist():
        h = (h * 0xD1342543DE82EF95 + w) & 0xFFFFFFFFFFFFFFFF
    return mixed(np.array([h], np.uint64))[0]
