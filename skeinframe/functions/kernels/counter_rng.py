"""Counter-based random numbers: Philox-4x32-10 and Threefry-2x32-16 (Salmon et al., 2011), vectorized; and
Mersenne twisters by blocks of the counter.

A draw depends on the key and its counter alone, so partitions can be made in any
order, or again, with the same values.
"""

from __future__ import annotations

import numpy as np

U32, U64 = np.uint32, np.uint64
# Multipliers and key increments of Philox-4x32; rotations and parity of Threefry-2x32.
PHILOX_M, PHILOX_W = (0xD2511F53, 0xCD9E8D57), (0x9E3779B9, 0xBB67AE85)
THREEFRY_R, THREEFRY_PARITY = (13, 15, 26, 6, 17, 29, 16, 24), 0x1BD11BDA


def philox(counter: np.ndarray, key: tuple[int, int], rounds: int = 10) -> np.ndarray:
    """counter: (n, 4) of 32 bits; the same shape comes back."""
    c = [counter[:, k].astype(U64) for k in range(4)]
    k0, k1 = key
    low = U64(0xFFFFFFFF)
    for _ in range(rounds):
        p0, p1 = c[0] * U64(PHILOX_M[0]), c[2] * U64(PHILOX_M[1])
        c = [(p1 >> U64(32)) ^ c[1] ^ U64(k0), p1 & low, (p0 >> U64(32)) ^ c[3] ^ U64(k1), p0 & low]
        k0, k1 = (k0 + PHILOX_W[0]) & 0xFFFFFFFF, (k1 + PHILOX_W[1]) & 0xFFFFFFFF
    return np.stack(c, axis=1).astype(U32)


def threefry(counter: np.ndarray, key: tuple[int, int], rounds: int = 16) -> np.ndarray:
    """counter: (n, 2) of 32 bits."""
    ks = [key[0], key[1], THREEFRY_PARITY ^ key[0] ^ key[1]]
    x0, x1 = counter[:, 0].astype(U32) + U32(ks[0]), counter[:, 1].astype(U32) + U32(ks[1])
    for r in range(rounds):
        x0 = x0 + x1
        turn = U32(THREEFRY_R[r % 8])
        x1 = ((x1 << turn) | (x1 >> (U32(32) - turn))) ^ x0
        if r % 4 == 3:
            n = r // 4 + 1
            x0 = x0 + U32(ks[n % 3])
            x1 = x1 + U32((ks[(n + 1) % 3] + n) & 0xFFFFFFFF)
    return np.stack([x0, x1], axis=1)


def words(index: np.ndarray, seed: int, kind: str = "philox", per: int = 2) -> np.ndarray:
    """`per` 32-bit words for each index (of 64 bits): (n, per), per at most 4 for Philox and 2 for Threefry."""
    index = index.astype(U64)
    halves = [(index & U64(0xFFFFFFFF)).astype(U32), (index >> U64(32)).astype(U32)]
    key = (seed & 0xFFFFFFFF, (seed >> 32) & 0xFFFFFFFF)
    if kind == "threefry":
        return threefry(np.stack(halves, axis=1), key)[:, :per]
    zero = np.zeros(len(index), U32)
    return philox(np.stack([*halves, zero, zero], axis=1), key)[:, :per]


#: Numbers that one Mersenne twister gives before the next index block starts its own.
TWISTER_BLOCK = 1 << 16


def _twisted(index: np.ndarray, seed: int, normal: bool) -> np.ndarray:
    """A Mersenne twister (MT19937) a block of indices, seeded by (seed, block)."""
    index = index.astype(np.int64)
    out = np.empty(len(index))
    block = index // TWISTER_BLOCK
    for b in np.unique(block):
        draw = np.random.Generator(np.random.MT19937([seed & 0xFFFFFFFFFFFFFFFF, int(b)]))
        values = draw.standard_normal(TWISTER_BLOCK) if normal else 1.0 - draw.random(TWISTER_BLOCK)
        at = block == b
        out[at] = values[index[at] % TWISTER_BLOCK]
    return out


def uniform(index: np.ndarray, seed: int, kind: str = "philox") -> np.ndarray:
    """Doubles in (0, 1], of 53 bits. kind: philox, threefry or mersenne."""
    if kind == "mersenne":
        return _twisted(index, seed, False)
    w = words(index, seed, kind)
    bits = (w[:, 0].astype(U64) << U64(21)) ^ (w[:, 1].astype(U64) >> U64(11))
    return 1.0 - (bits & U64((1 << 53) - 1)).astype(np.float64) / float(1 << 53)


def normal(index: np.ndarray, seed: int, kind: str = "philox") -> np.ndarray:
    """Box-Muller, from two uniforms of 32 bits each; the twister has its own method."""
    if kind == "mersenne":
        return _twisted(index, seed, True)
    w = words(index, seed, kind).astype(np.float64)
    radius = np.sqrt(-2 * np.log((w[:, 0] + 1) / 2**32))
    return radius * np.cos(2 * np.pi * w[:, 1] / 2**32)
