"""Vectorised hashes of parts of a text, and the byte comparison that settles what a hash only suggests."""

from __future__ import annotations

import hashlib

import numpy as np

_PRIME = (1 << 31) - 1
_BASES = (1_220_703_125, 1_566_083_941)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: From this many bytes on a part is hashed, or compared, by itself.
_LONG = 256
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x + np.uint64((0x632BE59BD9B4E019 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eights(text: bytes) -> np.ndarray:
    """The eight bytes from each place on."""
    return np.ndarray(len(text) + 1, "<u8", text + bytes(8), strides=(1,))


def parts(text: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of text[start:end], chained over eight bytes at a time; equal for equal contents."""
    eight, size = eights(text), end - start
    out = np.zeros(len(start), np.uint64)
    long = size > _LONG
    if long.any():
        some = np.flatnonzero(long)
        out[some] = [int.from_bytes(hashlib.blake2b(text[a:b], digest_size=8).digest(), "little") for a, b in zip(start[some].tolist(), end[some].tolist())]
    live, at = np.flatnonzero(~long), 0
    while len(live):
        left = np.minimum(size[live] - at, 8)
        bits = (8 * (8 - left)).astype(np.uint64)
        out[live] = mix((out[live] ^ (eight[start[live] + at] << bits)) + left.astype(np.uint64) * _FACTOR)
        at += 8
        live = live[size[live] > at]
    return out


def same(text: bytes, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each row whether text[a:a+n] and text[b:b+n] are the same bytes."""
    eight = eights(text)
    out, live, at = np.ones(len(a), bool), np.flatnonzero((a != b) & (n > 0)), 0
    while len(live):
        if at >= _LONG:
            out[live] = [text[i : i + k] == text[j : j + k] for i, j, k in zip(a[live].tolist(), b[live].tolist(), n[live].tolist())]
            break
        left = np.minimum(n[live] - at, 8)
        differ = ((eight[a[live] + at] ^ eight[b[live] + at]) << (8 * (8 - left)).astype(np.uint64)) != 0
        out[live[differ]] = False
        at += 8
        live = live[~differ]
        live = live[n[live] > at]
    return out


def distinct(text: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, which): the places of one part of each content, and for each part which of them it equals, byte for byte."""
    room = np.uint64(len(start).bit_length())
    ordered = np.sort(parts(text, start, end) >> room << room | np.arange(len(start), dtype=np.uint64))
    order = (ordered & ((np.uint64(1) << room) - np.uint64(1))).astype(np.int64)
    new = np.concatenate(([True], ordered[1:] >> room != ordered[:-1] >> room))
    first, which = order[new], np.empty(len(start), np.int64)
    which[order] = np.cumsum(new) - 1
    wrong = np.flatnonzero(~same(text, start, start[first][which], end - start))
    if len(wrong):  # a hash stood for two contents
        seen: dict[bytes, int] = {}
        for i in wrong.tolist():
            content = text[start[i] : end[i]]
            if content not in seen:
                seen[content] = len(first)
                first = np.append(first, i)
            which[i] = seen[content]
    return first, which


def grams(data: np.ndarray, doublings: int) -> np.ndarray:
    """Hashes of the 2**doublings bytes from each place on, made from those of half the length."""
    x = mix(data.astype(np.uint64))
    for k in range(doublings):
        half = 1 << k
        x = x[:-half] * _FACTOR + (x[half:] ^ (x[half:] >> np.uint64(29)))
        x ^= x >> np.uint64(32)
    return x


def _reduced(x: np.ndarray) -> np.ndarray:
    """Numbers modulo the prime."""
    p, s = np.uint64(_PRIME), np.uint64(31)
    x = (x & p) + (x >> s)
    x = (x & p) + (x >> s)
    return np.where(x >= p, x - p, x)


def _power(base: int, n: int) -> np.ndarray:
    """Powers of ``base``, at least ``n`` of them, by doubling."""
    have = _powers.get(base, np.ones(1, np.uint64))
    while len(have) < max(n, 1 << 16):
        have = _powers[base] = np.concatenate((have, _reduced(have * np.uint64(pow(base, len(have), _PRIME)))))
    return have[:n]


def prefix(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each base B, the sums of b[i] * B**i before each place, and the whole, modulo a prime. ``data`` holds bytes.

    Modulo a power of two any base would give some words (Thue-Morse) equal sums.
    """
    out = []
    for base in _BASES:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_reduced((data.astype(np.uint64) + np.uint64(1)) * _power(base, len(data))), out=sums[1:])
        out.append(_reduced(sums))
    return tuple(out)


def spans(sums: tuple[np.ndarray, ...], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] from prefix sums, equal for equal contents (and lengths are mixed in)."""
    both = []
    for base, s in zip(_BASES, sums, strict=True):
        inverse = _power(pow(base, -1, _PRIME), len(s))
        both.append(_reduced((s[end] + np.uint64(_PRIME) - s[start]) * inverse[start]))
    return mix((both[0] << np.uint64(31) | both[1]) + (end - start).astype(np.uint64) * _FACTOR)
