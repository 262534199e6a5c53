"""The best rows of each question, kept as arrays inside a task."""

from __future__ import annotations

import numpy as np

SCORE_DIGITS = 6
#: Scores this near may be equal once rounded.
NEAR = 1.1 * 10**-SCORE_DIGITS


class Best:
    """The best ``k`` vectors of each question so far, by rounded score and then by place; vectors (or chunks) lie in the order of their ids."""

    def __init__(self, n: int, k: int, own: np.ndarray | None = None):
        self.k, self.own = k, own
        self.score, self.at = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def floor(self, rows: np.ndarray) -> np.ndarray:
        """Scores under this cannot be among the best of ``rows``."""
        return self.score[rows, -1] - NEAR

    def offer(self, rows: np.ndarray, cols: np.ndarray, s: np.ndarray) -> None:
        """Take what is among the best of the scores ``s`` of questions ``rows`` with vectors ``cols``; minus infinity stands for no pair."""
        low, want = self.floor(rows), self.k + (self.own is not None)
        new = np.isneginf(low)
        if s.shape[1] > want and new.any():
            low[new] = np.partition(s[new], -want, axis=1)[:, -want] - NEAR
        r, c = np.nonzero((s >= low[:, None]) & (s > -np.inf))
        if self.own is not None:
            other = self.own[rows[r]] != cols[c]
            r, c = r[other], c[other]
        self.add(rows[r], cols[c], s[r, c])

    def add(self, r: np.ndarray, c: np.ndarray, s: np.ndarray) -> None:
        if not len(r):
            return
        hit = np.unique(r)
        row = np.concatenate((np.repeat(hit, self.k), r))
        score = np.concatenate((self.score[hit].ravel(), np.round(s, SCORE_DIGITS)))
        at = np.concatenate((self.at[hit].ravel(), c))
        order = np.lexsort((at, -score, row))
        first = np.searchsorted(row[order], hit)
        kept = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.score[hit], self.at[hit] = score[kept].reshape(-1, self.k), at[kept].reshape(-1, self.k)
