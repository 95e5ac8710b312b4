"""SHA-256 over many messages at once, with its midstates as plain bytes: what a hash object holds can be stored, copied and resumed."""

from __future__ import annotations

import math

import numpy as np


def _primes(n: int) -> list[int]:
    found: list[int] = []
    x = 2
    while len(found) < n:
        if all(x % p for p in found):
            found.append(x)
        x += 1
    return found


def _cube_root(n: int) -> int:
    r = 1 << -(-n.bit_length() // 3)
    while (better := (2 * r + n // (r * r)) // 3) < r:
        r = better
    return r


#: By the standard: fractional bits of the square roots of the first 8 primes, and of the cube roots of the first 64.
START = np.array([math.isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], np.uint32)
_HEX = np.frombuffer(b"".join(b"%02x" % i for i in range(256)), np.uint8).reshape(256, 2)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (8, n) after one more block (16, n) of 64 bytes each; a block (16, 1) goes to all of them."""
    w = list(block)
    for i in range(16, 64):
        x, y = w[i - 15], w[i - 2]
        w.append(w[i - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[i - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        t = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + (w[i] + ROUND[i])
        u = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = t + u, a, b, c, d + t, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def hex_block(digests: np.ndarray) -> np.ndarray:
    """Digests (n, 32) as blocks (16, n): their 64 hexadecimal digits are just one block of the hash."""
    return np.ascontiguousarray(_HEX[digests].reshape(len(digests), 64).view(">u4").astype(np.uint32).T)


def finish(state: np.ndarray, blocks: int) -> np.ndarray:
    """Digests (n, 32) of states that have taken so many whole blocks: the padding is a block of its own."""
    end = np.zeros((16, 1), np.uint32)
    end[0], end[14], end[15] = 0x80000000, (blocks * 512) >> 32, (blocks * 512) & 0xFFFFFFFF
    return unpack(compress(state, end))


def start(n: int) -> np.ndarray:
    return np.repeat(START[:, None], n, axis=1)


def unpack(state: np.ndarray) -> np.ndarray:
    """States (8, n) as rows of 32 bytes."""
    return np.ascontiguousarray(state.T).astype(">u4").view(np.uint8).reshape(-1, 32)


def pack(rows: np.ndarray) -> np.ndarray:
    """Rows of 32 bytes as states (8, n)."""
    return np.ascontiguousarray(np.ascontiguousarray(rows).view(">u4").astype(np.uint32).T)
