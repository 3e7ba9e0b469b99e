"""Golomb-Rice code of sorted integers and bit packing, on numpy arrays inside tasks."""
from __future__ import annotations

import numpy as np


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value: whole bytes first, then the bits left over."""
    n, whole, rest = len(values), width // 8, width % 8
    v = np.ascontiguousarray(values, dtype="<u8")
    out = v.view(np.uint8).reshape(n, 8)[:, :whole].tobytes()
    if rest:
        top = ((v >> np.uint64(8 * whole)) & np.uint64((1 << rest) - 1)).astype(np.uint8)
        out += np.packbits(np.unpackbits(top[:, None], axis=1)[:, 8 - rest:].ravel()).tobytes()
    return out


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    whole, rest = width // 8, width % 8
    v = np.zeros((n, 8), dtype=np.uint8)
    v[:, :whole] = np.frombuffer(data, np.uint8, n * whole).reshape(n, whole)
    if rest:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, -1, n * whole), count=n * rest).reshape(n, rest)
        v[:, whole] = np.packbits(np.pad(bits, ((0, 0), (8 - rest, 0))), axis=1)[:, 0]
    return v.view("<u8").ravel()


def packed_size(n: int, width: int) -> int:
    return n * (width // 8) + (n * (width % 8) + 7) // 8


def encode(values: np.ndarray) -> bytes:
    """Ascending unsigned integers, repeats allowed: gaps as a quotient in unary and ``k`` low bits.

    ``k`` is the logarithm of the mean gap, so the quotients take at most three bits a value.
    """
    n = len(values)
    if n == 0:
        return b""
    v = np.ascontiguousarray(values, dtype=np.uint64)
    gaps = np.diff(v, prepend=np.uint64(0))
    k = max(0, int(v[-1]) // n).bit_length()
    k = min(k, 63)
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotient + 1)
    unary = np.zeros(int(ends[-1]), dtype=np.uint8)
    unary[ends - 1] = 1
    head = np.packbits(unary).tobytes()
    return k.to_bytes(1, "little") + len(head).to_bytes(8, "little") + head + pack(gaps & np.uint64((1 << k) - 1), k)


def decode(data: bytes, n: int) -> np.ndarray:
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    k, size = data[0], int.from_bytes(data[1:9], "little")
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, 9)))[:n]
    quotient = np.diff(ends, prepend=-1) - 1
    return np.cumsum((quotient.astype(np.uint64) << np.uint64(k)) + unpack(data[9 + size:], n, k), dtype=np.uint64)
