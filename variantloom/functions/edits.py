"""Edit distances of many pairs of texts at once.

Spark's ``levenshtein`` fills the whole table of a pair character by character. Here 64 rows of the table are one
word of bits (Myers 1999), and all words of all pairs of a group take a step together: word ``w`` is ``w`` columns
behind the first, so that what enters it is what left the word above it a step before.
"""

from __future__ import annotations

import numpy as np

#: Words that take a step together, and the most words the table of a group's characters may have.
WORDS, TABLE = 8192, 1 << 22


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """Insertions, deletions and substitutions of code points between each two texts."""
    out = np.zeros(len(a), dtype=np.int32)
    pairs = [(k, *sorted((_codes(x), _codes(y)), key=len)) for k, (x, y) in enumerate(zip(a, b)) if x != y]
    for k, short, long in pairs:
        if not len(short):
            out[k] = len(long)
    pairs = sorted((p for p in pairs if len(p[1])), key=lambda p: (len(p[1]), len(p[2])))
    while pairs:
        # the shorter text gives the columns; as all pairs of a group get as many, some get equal characters in front
        n, most = 1, len(pairs[0][2])
        while n < len(pairs):
            columns = len(pairs[n][1])
            more = max(most + columns - len(pairs[n - 1][1]), len(pairs[n][2]))
            if (n + 1) * (more // 64 + 1) > WORDS:
                break
            n, most = n + 1, more
        _group(pairs[:n], out)
        pairs = pairs[n:]
    return out


def _group(pairs: list[tuple[int, np.ndarray, np.ndarray]], out: np.ndarray) -> None:
    n, columns = len(pairs), max(len(p[1]) for p in pairs)
    fill = np.array([columns - len(p[1]) for p in pairs])
    rows = fill + np.array([len(p[2]) for p in pairs])
    words = int(rows.max() + 63) // 64
    every = np.concatenate([x for p in pairs for x in p[1:]])
    number = np.zeros(int(every.max()) + 1, dtype=np.int64)
    number[every] = 1
    letters = int(number.sum()) + 1
    number = np.cumsum(number)
    if n > 1 and words * n * letters > TABLE:
        _group(pairs[: n // 2], out)
        _group(pairs[n // 2 :], out)
        return
    # number 0 is the character that fills
    short, table = np.zeros((columns, n), dtype=np.int64), np.zeros(words * n * letters, dtype=np.uint64)
    for k, (_, x, y) in enumerate(pairs):
        short[fill[k] :, k] = number[x]
        at = np.arange(rows[k])
        code = np.zeros(rows[k], dtype=np.int64)
        code[fill[k] :] = number[y]
        np.add.at(table, (at // 64 * n + k) * letters + code, np.uint64(1) << (at % 64).astype(np.uint64))
    base = np.arange(words * n, dtype=np.int64).reshape(words, n) * letters
    one, top = np.uint64(1), np.uint64(63)
    pv, mv = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), dtype=np.uint64)
    # what enters word w of a column from above, +1 or -1; the top row of the table grows by one
    plus, minus = np.zeros((words + 1, n), dtype=np.uint64), np.zeros((words + 1, n), dtype=np.uint64)
    plus[0] = 1
    backwards, index, held = short[::-1].copy(), np.empty((words, n), dtype=np.int64), np.empty((5, words, n), dtype=np.uint64)
    for step in range(columns + words - 1):
        low, high = max(0, step - columns + 1), min(words, step + 1)
        at = columns - 1 - step
        flat = np.add(base[low:high], backwards[at + low : at + high], out=index[low:high])
        eq, xv, xh, ph, mh = (v[low:high] for v in held)
        np.take(table, flat, out=eq, mode="clip")
        p, m, up, down = pv[low:high], mv[low:high], plus[low:high], minus[low:high]
        np.bitwise_or(eq, m, out=xv)
        eq |= down
        np.bitwise_and(eq, p, out=xh)
        xh += p
        xh ^= p
        xh |= eq
        np.bitwise_or(xh, p, out=ph)
        np.invert(ph, out=ph)
        ph |= m
        np.bitwise_and(p, xh, out=mh)
        np.right_shift(ph, top, out=eq)
        np.right_shift(mh, top, out=xh)
        ph <<= one
        ph |= up
        mh <<= one
        mh |= down
        plus[low + 1 : high + 1], minus[low + 1 : high + 1] = eq, xh
        np.bitwise_or(xv, ph, out=p)
        np.invert(p, out=p)
        p |= mh
        np.bitwise_and(ph, xv, out=m)
    left = np.clip(rows[None, :] - 64 * np.arange(words)[:, None], 0, 64).astype(np.uint64)
    mask = np.where(left == 64, ~np.uint64(0), (one << (left % np.uint64(64))) - one)
    total = columns + np.bitwise_count(pv & mask).sum(axis=0, dtype=np.int64) - np.bitwise_count(mv & mask).sum(axis=0, dtype=np.int64)
    out[[p[0] for p in pairs]] = total
