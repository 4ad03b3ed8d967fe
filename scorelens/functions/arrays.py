"""Array helpers for Arrow batches of texts: slices, words, and MD5 of many short messages at once."""

from __future__ import annotations

import numpy as np

# RFC 1321: shifts of a round, constants, and the message word each step takes.
_SHIFTS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).reshape(-1)
_SINES = (np.abs(np.sin(np.arange(1, 65))) * 2.0 ** 32).astype(np.uint32)
_TAKES = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_BLOCK = 16384  # messages hashed at once, so that the state stays in the cache


def md5_word(messages: np.ndarray) -> np.ndarray:
    """First 32 bits of the MD5 digest (as its first 8 hex digits are read) of each row of bytes, at most 55 long."""
    n, size = messages.shape
    out = np.empty(n, np.uint32)
    for start in range(0, n, _BLOCK):
        part = messages[start:start + _BLOCK]
        block = np.zeros((len(part), 64), np.uint8)
        block[:, :size] = part
        block[:, size] = 0x80
        block[:, 56] = size * 8 & 0xFF
        block[:, 57] = size * 8 >> 8
        word = np.ascontiguousarray(block.view("<u4").T)
        a, b, c, d = (np.full(len(part), v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
        for i in range(64):
            if i < 16:
                f = d ^ (b & (c ^ d))
            elif i < 32:
                f = c ^ (d & (b ^ c))
            elif i < 48:
                f = b ^ c ^ d
            else:
                f = c ^ (b | ~d)
            f += a
            f += _SINES[i]
            f += word[_TAKES[i]]
            left = np.uint32(_SHIFTS[i])
            a, d, c, b = d, c, b, b + ((f << left) | (f >> np.uint32(32 - left)))
        out[start:start + _BLOCK] = (a + np.uint32(0x67452301)).byteswap()
    return out


def slices(column, n_bytes: int):
    """Yield (first row, starts, bytes) for runs of whole rows of a binary column, ``n_bytes`` or one row long.

    Row ``first + d`` holds ``bytes[starts[d]:starts[d + 1]]``.
    """
    wide = np.dtype(np.int64 if str(column.type).startswith("large") else np.int32)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + n_bytes, "right")) - 1)
        yield lo, at[lo:hi + 1] - at[lo], data[at[lo]:at[hi]]
        lo = hi


def words_of(text: np.ndarray, starts: np.ndarray):
    """(begin, end, row, pos) of the runs between blanks and line feeds, cut at the rows' ends; ``pos`` counts the
    pieces of the row's split, so it begins at 1 where a row begins with a separator."""
    full = (text != 32) & (text != 10)
    first = np.zeros(len(text) + 1, bool)
    first[starts] = True
    first = first[:-1]
    begin = np.flatnonzero(full & (first | np.concatenate([[True], ~full[:-1]])))
    end = np.flatnonzero(full & np.concatenate([first[1:] | ~full[1:], [True]])[:len(text)]) + 1
    row = np.searchsorted(starts, begin, "right") - 1
    base = np.searchsorted(begin, starts[:-1])
    led = np.zeros(len(starts) - 1, np.int64)
    some = starts[1:] > starts[:-1]
    led[some] = ~full[starts[:-1][some]]
    return begin, end, row, np.arange(len(begin)) - base[row] + led[row]
