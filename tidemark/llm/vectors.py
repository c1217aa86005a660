"""Numpy helpers for Arrow batches: words and their hashes, window hashes, Rice-coded sorted integers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Text bytes handled at once (a longer text is handled alone), and bytes of which prefix sums are held at once.
SLICE_BYTES, CHUNK = 2 << 20, 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << int(n).bit_length()
            with np.errstate(over="ignore"):
                self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(n - 1, x, U)])) for x in (self.base, self.inverse))
        return self.up, self.down


_BYTES, _WORDS = _Powers(0x9E3779B97F4A7C15), _Powers(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def release() -> None:
    """Gives freed memory back to the system; a worker that is kept for later tasks else holds what its largest one took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def releasing(task: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The task, with memory given back at its end."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        release()

    return run


def releasing_group(task: Callable[[pa.Table], pa.Table]):
    """The same for a function of one group."""

    def run(table: pa.Table) -> pa.Table:
        out = task(table)
        release()
        return out

    return run


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in runs of at most `most` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def pieces(texts: pa.Array, most: int = SLICE_BYTES // 2) -> tuple[pa.Array, np.ndarray]:
    """(texts of at most so many characters, the row that each is of): longer ones are cut at a space, or where there is none for long, anywhere."""
    if not len(texts) or np.diff(buffers(texts)[1]).max() <= most:
        return texts, np.arange(len(texts))
    out, owner = [], []
    for i, t in enumerate(texts.to_pylist()):
        at, t = 0, t or ""
        while len(t) - at > most:
            cut = t.rfind(" ", at + most // 2, at + most) + 1 or at + most
            out.append(t[at:cut])
            owner.append(i)
            at = cut
        out.append(t[at:])
        owner.append(i)
    return pa.array(out, pa.string()), np.array(owner)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, one after the other, and where each begins (and the last ends); null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and of none after the last, bytes, word starts, word ends)."""
    data, offsets = buffers(texts)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    del inside, first, last
    return hashed(data, starts, ends), np.searchsorted(starts, offsets), data, starts, ends


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes starts[i] .. ends[i] - 1, for each i; both ascend."""
    return mix(_polynomials(data, starts, ends) + (ends - starts).astype(U) * U(0xA24BAED4963EE407))


def _polynomials(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomials of the bytes starts[i] .. ends[i] - 1 modulo 2**64.

    Prefix sums are made CHUNK bytes at a time and read at the words' edges only, so a long text needs no more of
    them than a short one, and a word may go on over many chunks.
    """
    up, down = _BYTES.get(min(len(data), CHUNK) + 1)
    at_start, at_end, shift = np.empty(len(starts), U), np.empty(len(ends), U), np.empty(len(starts), U)
    total, power, inverse = U(0), 1, 1
    sums = np.zeros(min(len(data), CHUNK) + 1, U)
    with np.errstate(over="ignore"):
        for o in range(0, len(data), CHUNK):
            part = data[o : o + CHUNK]
            n = len(part)
            np.cumsum((part.astype(U) + U(1)) * up[:n], out=sums[1 : n + 1])
            a, b = np.searchsorted(starts, (o, o + n))
            own = starts[a:b] - o
            at_start[a:b], shift[a:b] = total + U(power) * sums[own], U(inverse) * down[own]
            a, b = np.searchsorted(ends, (o, o + n), "right")
            at_end[a:b] = total + U(power) * sums[ends[a:b] - o]
            total += U(power) * sums[n]
            power, inverse = power * pow(_BYTES.base, n, 1 << 64) % (1 << 64), inverse * pow(_BYTES.inverse, n, 1 << 64) % (1 << 64)
    return (at_end - at_start) * shift


def windows(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Hash of the words starts[i] .. starts[i] + lengths[i] - 1, for each i."""
    up, down = _WORDS.get(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U)
    np.cumsum((hashes | U(1)) * up[: len(hashes)], out=sums[1:])
    n = np.broadcast_to(np.asarray(lengths, np.int64), starts.shape)
    return mix((sums[starts + n] - sums[starts]) * down[starts] ^ n.astype(U) * U(0x9FB21C651E98DF25))


def window_starts(first: np.ndarray, size: int) -> np.ndarray:
    """Where windows of `size` words start that lie within one text."""
    n = np.maximum(np.diff(first) - size + 1, 0)
    return ranges(first[:-1], n)


def ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (n[0] of them), begin[1], ..."""
    total = int(n.sum())
    skip = np.repeat(begin - (np.cumsum(n) - n), n)
    return np.arange(total, dtype=np.int64) + skip


def rice(values: np.ndarray, span: int) -> bytes:
    """Sorted integers below span, as Golomb codes of their gaps with a power of two as divisor (Rice codes).

    Quotients in unary and remainders in bits stand apart, so that both are read and written by whole arrays.
    """
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values, prepend=values[:1] * U(0))
    k = max(0, int(span // n).bit_length() - 1)
    quotients = (gaps >> U(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + n, np.uint8)
    unary[np.cumsum(quotients) + np.arange(n)] = 1
    planes = [((gaps >> U(8 * b)) & U(255)).astype(np.uint8).tobytes() for b in range(k // 8)]
    rest = k % 8
    if rest:
        top = ((gaps >> U(k - rest)) & U((1 << rest) - 1)).astype(np.uint8)
        planes.append(np.packbits(((top[:, None] >> np.arange(rest, dtype=np.uint8)) & 1).ravel()).tobytes())
    bits = np.packbits(unary).tobytes()
    return b"".join([n.to_bytes(4, "little"), k.to_bytes(1, "little"), len(bits).to_bytes(4, "little"), bits, *planes])


def unrice(code: bytes) -> np.ndarray:
    if not code:
        return np.zeros(0, U)
    n, k, size = int.from_bytes(code[:4], "little"), code[4], int.from_bytes(code[5:9], "little")
    at = 9 + size
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(code, np.uint8, size, 9)))[:n]
    gaps = np.diff(ones, prepend=-1).astype(U) - U(1)
    gaps <<= U(k)
    for b in range(k // 8):
        gaps |= np.frombuffer(code, np.uint8, n, at).astype(U) << U(8 * b)
        at += n
    if rest := k % 8:
        bits = np.unpackbits(np.frombuffer(code, np.uint8, -1, at))[: n * rest].reshape(n, rest)
        gaps |= (bits.astype(np.uint8) << np.arange(rest, dtype=np.uint8)).sum(1, dtype=np.uint8).astype(U) << U(k - rest)
    return np.cumsum(gaps)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]])] if len(x) else x
