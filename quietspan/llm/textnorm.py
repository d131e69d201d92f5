"""Byte-level word normalisation: A-Z lower-cased, words are maximal runs of digits, letters and non-ASCII."""

from __future__ import annotations

import numpy as np

_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def _table() -> bytes:
    table = bytearray(range(256))
    for b in _SEPARATORS:
        table[b] = 0x20
    for b in range(0x41, 0x5B):
        table[b] = b + 32
    return bytes(table)


#: Maps each byte to its normal form; the length stays, so offsets carry over. Every separator becomes a space.
TABLE = _table()


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def joined(parts: list[bytes]) -> bytes:
    """Words with one space around each: a word sequence is a substring exactly when its joined form is."""
    return b" " + b" ".join(parts) + b" " if parts else b" "


def word_byte_offsets(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word in the original text."""
    inside = np.frombuffer(text.translate(TABLE), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def code_points_before(text: bytes) -> np.ndarray:
    """For each byte offset (and the end), how many code points start before it."""
    lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    return np.concatenate(([0], np.cumsum(lead)))
