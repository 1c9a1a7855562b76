"""Nearest vectors by cosine, exact, with most products left out."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Scores are compared rounded to so many digits.
DIGITS = 9
#: Below this many vectors a single product is cheaper than balls.
FEW = 1_024


def unit_rows(vectors: Iterable) -> np.ndarray:
    """Vectors of one size as rows of length one; NaN where one has no length."""
    m = np.stack([np.asarray(x, dtype=np.float64) for x in vectors])
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))
    return np.divide(m, norm[:, None], out=np.full_like(m, np.nan), where=norm[:, None] > 0)


def _first(score: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k best scores with their places; the earlier place wins a tie."""
    order = np.lexsort((at, -np.round(score, DIGITS)), axis=-1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(at, order, 1)


class Balls:
    """Vectors of length one in balls: about as many balls as a ball has members.

    The angle between a question and any member is at least the angle to the ball's centre less the
    ball's radius, so a ball whose bound is below the k-th score found so far needs no product.
    """

    def __init__(self, vectors: np.ndarray):
        n = len(vectors)
        self.vectors, self.products = vectors, 0
        count = 1 if n < FEW else round(np.sqrt(n))
        centres = vectors[np.linspace(0, n - 1, count).astype(int)] if n else vectors[:0]
        for _ in range(2 if count > 1 else 0):
            ball = np.argmax(vectors @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, ball, vectors)
            length = np.sqrt(np.einsum("ij,ij->i", sums, sums))
            centres = np.where(length[:, None] > 0, sums / np.where(length > 0, length, 1)[:, None], centres)
        ball = np.argmax(vectors @ centres.T, axis=1) if count > 1 else np.zeros(n, int)
        self.centres, order = centres, np.argsort(ball, kind="stable")
        ends = np.cumsum(np.bincount(ball, minlength=count))
        self.members = [order[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        angle = np.arccos(np.clip(np.einsum("ij,ij->i", vectors, centres[ball]), -1, 1)) if n else np.zeros(0)
        self.radius = np.array([angle[m].max(initial=0.0) for m in self.members])

    def best(self, asks: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, places) of the k nearest vectors of each question, best first; -inf and a place past the end fill up."""
        n, m = len(self.vectors), len(asks)
        score, at = np.full((m, k), -np.inf), np.full((m, k), n)
        if not n or not m or not k:
            return score, at
        angle = np.arccos(np.clip(asks @ self.centres.T, -1, 1))
        # arccos loses half the digits near its ends, and scores are compared rounded: hence the slack
        bound = np.cos(np.maximum(0.0, angle - self.radius - 1e-7)) + 10.0**-DIGITS
        order = np.argsort(-bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, 1)
        done, width = 0, 1
        while done < len(self.members):
            wave = order[:, done : done + width]
            wanted = bound[:, done : done + width] >= np.round(score[:, -1:], DIGITS)
            if not wanted.any():
                break
            for b in np.unique(wave[wanted]):
                who = np.flatnonzero((wanted & (wave == b)).any(axis=1))
                new = asks[who] @ self.vectors[self.members[b]].T
                self.products += new.size
                places = np.broadcast_to(self.members[b], new.shape)
                score[who], at[who] = _first(np.concatenate([score[who], new], axis=1), np.concatenate([at[who], places], axis=1), k)
            done, width = done + width, 2 * width
        return score, at
