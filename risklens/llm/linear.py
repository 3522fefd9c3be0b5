"""Logistic regression on hashed word features, for bounded training sets."""

from __future__ import annotations

import numpy as np

from risklens.llm.textvec import U64, mix

FEATURES = 1 << 14


def features(words: np.ndarray, pairs: bool, inside: np.ndarray | None = None) -> np.ndarray:
    """Feature number of each word hash, then, with ``pairs``, of each word with its
    successor (``inside``: positions whose successor is in the same text)."""
    out = (mix(words) >> U64(50)).astype(np.int64)
    if not pairs:
        return out
    two = mix(words[:-1] * U64(0x9FB21C651E98DF25) + words[1:] + U64(1))
    return np.concatenate([out, (two[inside] >> U64(50)).astype(np.int64)])


class Logistic:
    """One-against-rest scores for ``classes``; each feature counts once per text and
    is scaled by its log-count ratio, so rare telling words weigh enough.  ``priors`` are
    the classes' shares where the training set is balanced by choice."""

    def __init__(self, texts: list[np.ndarray], labels: list[int], n_classes: int, l2: float = 1e-3, rounds: int = 200,
                 priors: list[float] | None = None):
        self.weight = np.zeros((n_classes, FEATURES))
        self.bias = np.zeros(n_classes)
        y = np.array(labels)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        flat = np.concatenate(texts) if len(texts) else np.zeros(0, dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        for c in range(n_classes):
            target = y == c
            if not target.any() or target.all():
                self.bias[c] = 20.0 if target.any() else -20.0
                continue
            yes = np.bincount(flat[target[owner]], minlength=FEATURES) + 1.0
            no = np.bincount(flat[~target[owner]], minlength=FEATURES) + 1.0
            ratio = np.log(yes / (target.sum() + 2)) - np.log(no / ((~target).sum() + 2))
            balance = np.where(target, 0.5 / target.sum(), 0.5 / (~target).sum())
            w, b = np.zeros(FEATURES), 0.0
            step_w, step_b = np.zeros(FEATURES), 0.0
            # the curvature is at most a quarter of the mean squared length
            norm = float((np.bincount(owner, weights=ratio[flat] ** 2, minlength=len(texts)) * balance).sum()) + 1
            rate = 4.0 / norm
            for _ in range(rounds):  # accelerated full-batch descent
                score = np.bincount(owner, weights=(w * ratio)[flat], minlength=len(texts)) + b
                error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - target) * balance
                grad = np.bincount(flat, weights=error[owner], minlength=FEATURES) * ratio + l2 * w / norm
                step_w, step_b = 0.9 * step_w - rate * grad, 0.9 * step_b - rate * error.sum()
                w, b = w + step_w, b + step_b
            # trained on balanced classes; a known share moves the odds
            share = min(max(priors[c], 1e-4), 1 - 1e-4) if priors else 0.5
            self.weight[c], self.bias[c] = w * ratio, b + np.log(share / (1 - share))

    def scores(self, flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Scores (texts x classes) of distinct (owner, feature) pairs."""
        return np.stack([np.bincount(owner, weights=w[flat], minlength=n) + b for w, b in zip(self.weight, self.bias)], axis=1)


def posteriors(scores: np.ndarray) -> np.ndarray:
    """Probabilities over the classes: one-against-rest ones, normalised."""
    p = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
    return p / p.sum(axis=1, keepdims=True)


def distinct(owner: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (owner, feature) once."""
    both = np.sort(owner * FEATURES + feature)
    both = both[np.diff(both, prepend=-1) != 0]
    return both // FEATURES, both % FEATURES
