"""Texts whose white space is more than spaces and newlines."""

from __future__ import annotations

import numpy as np

# Every character that some definition calls white space, but for the space and the newline.
ODD = [chr(c) for c in (9, 11, 12, 13, *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_ODD_BYTES = [c.encode() for c in ODD]


def odd_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The rows that have such a character, for texts as flat UTF-8."""
    raw = data.tobytes()
    found = [c for c in _ODD_BYTES if c in raw]
    if not found:
        return np.empty(0, np.int64)
    rows = [k for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)) if any(c in raw[a:b] for c in found)]
    return np.array(rows, np.int64)
