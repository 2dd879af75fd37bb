"""Published byte-string hashes over Arrow batches.

Each function takes an ``(n, length)`` uint8 matrix, one key per row, and hashes
all rows at once with wrap-around numpy arithmetic. They run inside Arrow UDFs;
see :mod:`tallyweave.functions.hashing` for the columns built on them.
"""

from __future__ import annotations

import numpy as np

U32, U64 = np.uint32, np.uint64


def _words(keys: np.ndarray, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Little-endian words of ``width`` bytes and the bytes left over."""
    length = keys.shape[1]
    whole = length // width * width
    dtype = "<u4" if width == 4 else "<u8"
    head = np.ascontiguousarray(keys[:, :whole]).view(dtype)
    return [head[:, i] for i in range(whole // width)], keys[:, whole:]


def _tail_word(tail: np.ndarray, dtype) -> np.ndarray:
    word = np.zeros(len(tail), dtype)
    for i in range(tail.shape[1]):
        word |= tail[:, i].astype(dtype) << dtype(8 * i)
    return word


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    bits = x.dtype.itemsize * 8
    return (x << x.dtype.type(r)) | (x >> x.dtype.type(bits - r))


def fasthash64(keys: np.ndarray, seed: int) -> np.ndarray:
    # Fixed values of the published algorithm.
    multiplier = U64(0x880355F21E6D1965)
    mixer = U64(0x2127599BF4325C37)

    def mix(v):
        v = (v ^ (v >> U64(23))) * mixer
        return v ^ (v >> U64(47))

    n, length = keys.shape
    words, tail = _words(keys, 8)
    if tail.shape[1]:
        words.append(_tail_word(tail, U64))
    h = np.full(n, U64(seed) ^ (np.array([length], U64) * multiplier)[0], U64)
    for word in words:
        h = (h ^ mix(word)) * multiplier
    return mix(h)


def fasthash32(keys: np.ndarray, seed: int) -> np.ndarray:
    h = fasthash64(keys, seed)
    return (h - (h >> U64(32))).astype(U32)


# The primes of xxHash.
XX32 = tuple(map(U32, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)))
XX64 = tuple(
    map(
        U64,
        (
            0x9E3779B185EBCA87,
            0xC2B2AE3D27D4EB4F,
            0x165667B19E3779F9,
            0x85EBCA77C2B2AE63,
            0x27D4EB2F165667C5,
        ),
    )
)


def _wrap_sum(dtype, *terms: int) -> np.generic:
    """Constant arithmetic that wraps without a numpy warning."""
    return dtype(sum(int(t) for t in terms) % (1 << (dtype().itemsize * 8)))


def _stripes(words, primes, rotation, seed, dtype, n):
    p1, p2 = primes[0], primes[1]
    lanes = [
        np.full(n, _wrap_sum(dtype, seed, *offset), dtype)
        for offset in ((p1, p2), (p2,), (0,), (-int(p1),))
    ]
    while len(words) >= 4:
        for i in range(4):
            lanes[i] = _rotl(lanes[i] + words[i] * p2, rotation) * p1
        words = words[4:]
    return lanes, words


def xxhash32(keys: np.ndarray, seed: int) -> np.ndarray:
    p1, p2, p3, p4, p5 = XX32
    n, length = keys.shape
    words, tail = _words(keys, 4)
    if length >= 16:
        lanes, words = _stripes(words, XX32, 13, seed, U32, n)
        h = sum((_rotl(v, r) for v, r in zip(lanes, (1, 7, 12, 18))), np.zeros(n, U32))
    else:
        h = np.full(n, _wrap_sum(U32, seed, p5), U32)
    h = h + _wrap_sum(U32, length)
    for word in words:
        h = _rotl(h + word * p3, 17) * p4
    for i in range(tail.shape[1]):
        h = _rotl(h + tail[:, i].astype(U32) * p5, 11) * p1
    h = (h ^ (h >> U32(15))) * p2
    h = (h ^ (h >> U32(13))) * p3
    return h ^ (h >> U32(16))


def xxhash64(keys: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """Keys of less than 32 bytes may have a seed each."""
    p1, p2, p3, p4, p5 = XX64
    n, length = keys.shape

    def scramble(word):
        return _rotl(word * p2, 31) * p1

    words, tail = _words(keys, 8)
    if length >= 32:
        lanes, words = _stripes(words, XX64, 31, seed, U64, n)
        h = sum((_rotl(v, r) for v, r in zip(lanes, (1, 7, 12, 18))), np.zeros(n, U64))
        for lane in lanes:
            h = (h ^ scramble(lane)) * p1 + p4
    else:
        h = seed + p5 if isinstance(seed, np.ndarray) else np.full(n, _wrap_sum(U64, seed, p5), U64)
    h = h + _wrap_sum(U64, length)
    for word in words:
        h = _rotl(h ^ scramble(word), 27) * p1 + p4
    if tail.shape[1] >= 4:
        h = _rotl(h ^ (_tail_word(tail[:, :4], U64) * p1), 23) * p2 + p3
        tail = tail[:, 4:]
    for i in range(tail.shape[1]):
        h = _rotl(h ^ (tail[:, i].astype(U64) * p5), 11) * p1
    h = (h ^ (h >> U64(33))) * p2
    h = (h ^ (h >> U64(29))) * p3
    return h ^ (h >> U64(32))


def murmur3_32(keys: np.ndarray, seed: int) -> np.ndarray:
    # Fixed values of the published algorithm.
    c1, c2 = U32(0xCC9E2D51), U32(0x1B873593)
    n, length = keys.shape
    words, tail = _words(keys, 4)
    h = np.full(n, seed, U32)
    for word in words:
        h = _rotl(h ^ (_rotl(word * c1, 15) * c2), 13) * U32(5) + U32(0xE6546B64)
    if tail.shape[1]:
        h = h ^ (_rotl(_tail_word(tail, U32) * c1, 15) * c2)
    h = h ^ U32(length)
    h = (h ^ (h >> U32(16))) * U32(0x85EBCA6B)
    h = (h ^ (h >> U32(13))) * U32(0xC2B2AE35)
    return h ^ (h >> U32(16))


# Rotations of lookup3, as (changed word, other word, bits).
# A step of the mix also adds the third word to the other one.
LOOKUP3_MIX = ((0, 2, 4), (1, 0, 6), (2, 1, 8), (0, 2, 16), (1, 0, 19), (2, 1, 4))
LOOKUP3_FINAL = (
    (2, 1, 14), (0, 2, 11), (1, 0, 25), (2, 1, 16), (0, 2, 4), (1, 0, 14), (2, 1, 24),
)
LOOKUP3_START = 0xDEADBEEF


def _lookup3_final(state):
    for x, y, r in LOOKUP3_FINAL:
        state[x] = (state[x] ^ state[y]) - _rotl(state[y], r)
    return state[2]


def lookup3(keys: np.ndarray, seed: int) -> np.ndarray:
    """Bob Jenkins' lookup3 over bytes, also known as jhash."""
    n, length = keys.shape
    state = [np.full(n, _wrap_sum(U32, LOOKUP3_START, length, seed), U32) for _ in range(3)]
    while keys.shape[1] > 12:
        words, _ = _words(keys[:, :12], 4)
        state = [s + w for s, w in zip(state, words)]
        for x, y, r in LOOKUP3_MIX:
            state[x] = (state[x] - state[y]) ^ _rotl(state[y], r)
            state[y] = state[y] + state[3 - x - y]
        keys = keys[:, 12:]
    if not keys.shape[1]:
        return state[2]
    for i in range(3):
        state[i] = state[i] + _tail_word(keys[:, 4 * i : 4 * i + 4], U32)
    return _lookup3_final(state)


def lookup3_words(words: list[np.ndarray], seed: int) -> np.ndarray:
    """lookup3 over one, two or three 32-bit words."""
    n = len(words[0])
    start = _wrap_sum(U32, LOOKUP3_START, 4 * len(words), seed)
    padded = [w.astype(U32) for w in words] + [np.zeros(n, U32)] * (3 - len(words))
    return _lookup3_final([w + start for w in padded])


def siphash24(keys: np.ndarray, secret: bytes) -> np.ndarray:
    n, length = keys.shape
    k0, k1 = (int.from_bytes(secret[i : i + 8], "little") for i in (0, 8))
    # The initial state of SipHash ("somepseudorandomlygeneratedbytes").
    v = [
        np.full(n, U64(k ^ c), U64)
        for k, c in (
            (k0, 0x736F6D6570736575),
            (k1, 0x646F72616E646F6D),
            (k0, 0x6C7967656E657261),
            (k1, 0x7465646279746573),
        )
    ]

    def half_round(a, b, c, d, s, t):
        v[a] = v[a] + v[b]
        v[c] = v[c] + v[d]
        v[b] = _rotl(v[b], s) ^ v[a]
        v[d] = _rotl(v[d], t) ^ v[c]
        v[a] = _rotl(v[a], 32)

    def rounds(count):
        for _ in range(count):
            half_round(0, 1, 2, 3, 13, 16)
            half_round(2, 1, 0, 3, 17, 21)

    words, tail = _words(keys, 8)
    for word in [*words, _tail_word(tail, U64) | U64((length & 255) << 56)]:
        v[3] = v[3] ^ word
        rounds(2)
        v[0] = v[0] ^ word
    v[2] = v[2] ^ U64(255)
    rounds(4)
    return v[0] ^ v[1] ^ v[2] ^ v[3]
