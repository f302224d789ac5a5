"""How alike two texts are, by the matching blocks of difflib, found without walking all pairs of characters again for each block."""

from __future__ import annotations

import difflib
from bisect import bisect_left

import numpy as np

#: Pairs of equal character pairs that are listed at once; texts with more go to difflib itself, whose memory doesn't grow with them.
MOST_PAIRS = 4_000_000


def _before(a: str, i: int, alo: int, b: str, j: int, blo: int) -> int:
    """How many characters before a[i] and b[j] are the same."""
    most, n, step = min(i - alo, j - blo), 0, 16
    while n < most:
        step = min(step, most - n)
        if a[i - n - step : i - n] == b[j - n - step : j - n]:
            n += step
            step *= 2
        elif step == 1:
            break
        else:
            most, step = min(most, n + step - 1), step // 2
    return n


def _after(a: str, i: int, ahi: int, b: str, j: int, bhi: int) -> int:
    """How many characters from a[i] and b[j] on are the same."""
    most, n, step = min(ahi - i, bhi - j), 0, 16
    while n < most:
        step = min(step, most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n += step
            step *= 2
        elif step == 1:
            break
        else:
            most, step = min(most, n + step - 1), step // 2
    return n


def _runs(a: np.ndarray, b: np.ndarray, rare: np.ndarray) -> np.ndarray | None:
    """The longest runs of two or more characters, all of them rare in b, that stand in both: rows of start in a, start in b, length; None if there are too many pairs."""
    def two(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = np.isin(x, rare)
        at = np.flatnonzero(ok[:-1] & ok[1:])
        return at, x[at].astype(np.int64) << 32 | x[at + 1]

    (ai, ak), (bi, bk) = two(a), two(b)
    order = np.argsort(bk, kind="stable")
    bi, bk = bi[order], bk[order]
    low = np.searchsorted(bk, ak, "left")
    n = np.searchsorted(bk, ak, "right") - low
    total = int(n.sum())
    if total > MOST_PAIRS:
        return None
    i = np.repeat(ai, n)
    j = bi[np.repeat(low, n) + np.arange(total) - np.repeat(np.cumsum(n) - n, n)]
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.diff(i, prepend=-9) - 1 | np.diff(i - j, prepend=len(a) + 9)) if total else np.zeros(0, np.int64)
    return np.stack([i[first], j[first], np.diff(first, append=total) + 1])


def matched(a: str, b: str) -> int | None:
    """The characters in difflib.SequenceMatcher(None, a, b).get_matching_blocks(), block by block as there; None if too many pairs would be listed.

    A block grows from the longest run of characters that are rare in b (difflib: not popular), the first of equals by its end in a, then in b. Runs of two or more are listed
    once and cut to what is left on either side of a block. Where none is left, the first rare character of a that b has is the run; it is found by a search in b's list
    of its places.
    """
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    letters, count = np.unique(y, return_counts=True)
    rare = letters[count <= len(b) // 100 + 1] if len(b) >= 200 else letters
    runs = _runs(x, y, rare)
    if runs is None:
        return None
    places = {c: np.flatnonzero(y == c).tolist() for c in np.intersect1d(rare, x).tolist()}
    at = np.flatnonzero(np.isin(x, np.fromiter(places, np.uint32, len(places)))).tolist()
    where = [places[c] for c in x[at].tolist()]
    total, todo = 0, [(0, len(a), 0, len(b), runs)]
    while todo:
        alo, ahi, blo, bhi, runs = todo.pop()
        if runs.shape[1]:
            i, j, k = runs
            cut = np.maximum(np.maximum(alo - i, blo - j), 0)
            k = np.minimum(np.minimum(ahi - i, bhi - j), k) - cut
            keep = k > 1
            runs = np.stack([(i + cut)[keep], (j + cut)[keep], k[keep]])
        i, j, k = alo, blo, 0
        if runs.shape[1]:
            longest = np.flatnonzero(runs[2] == runs[2].max())
            ends = runs[0, longest] * (len(b) + 1) + runs[1, longest]
            i, j, k = runs[:, longest[ends.argmin()]].tolist()
        else:
            for p in range(bisect_left(at, alo), bisect_left(at, ahi)):
                q = bisect_left(where[p], blo)
                if q < len(where[p]) and where[p][q] < bhi:
                    i, j, k = at[p], where[p][q], 1
                    break
        back = _before(a, i, alo, b, j, blo)
        i, j, k = i - back, j - back, k + back
        k += _after(a, i + k, ahi, b, j + k, bhi)
        if k:
            total += k
            if alo < i and blo < j:
                todo.append((alo, i, blo, j, runs))
            if i + k < ahi and j + k < bhi:
                todo.append((i + k, ahi, j + k, bhi, runs))
    return total


def block_ratio(a: str, b: str) -> float:
    """difflib.SequenceMatcher(None, a, b).ratio(), the same number."""
    total = matched(a, b)
    if total is None:
        return difflib.SequenceMatcher(None, a, b).ratio()
    return 2.0 * total / (len(a) + len(b)) if a or b else 1.0
