"""Linear-chain conditional random field in numpy: maximum likelihood training, batched Viterbi.

A position is described by one category per feature template; the emission
score of a label is the sum of its weights for those categories.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


def padded(lengths: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into the flat positions, mask) of shape (sequences, longest)."""
    first = np.cumsum(lengths) - lengths
    step = np.arange(longest)
    mask = step[None, :] < lengths[:, None]
    return np.where(mask, first[:, None] + step[None, :], 0), mask


def length_groups(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Sequences of like length together, so that padding stays under a factor of two."""
    kind = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for k in np.unique(kind[lengths > 0]):
        yield np.flatnonzero((kind == k) & (lengths > 0))


@dataclass
class Crf:
    weights: np.ndarray      # (categories of all templates, labels)
    offsets: np.ndarray      # first category of each template
    transitions: np.ndarray  # (from, to)
    start: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """features: (positions, templates) category of each template."""
        out = np.zeros((len(features), self.weights.shape[1]))
        for t, first in enumerate(self.offsets):
            out += self.weights[first + features[:, t]]
        return out

    def decode(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best label of every position; ``lengths``: positions of each sequence, one after the other."""
        scores, best = self.emissions(features), np.zeros(len(features), np.int8)
        first = np.cumsum(lengths) - lengths
        for group in length_groups(lengths):
            own = lengths[group]
            longest = int(own.max())
            step = np.arange(longest)
            mask = step[None, :] < own[:, None]
            at = np.where(mask, first[group][:, None] + step[None, :], 0)
            path = self._viterbi(scores[at], mask)
            best[at[mask]] = path[mask]
        return best

    def _viterbi(self, e: np.ndarray, mask: np.ndarray) -> np.ndarray:
        n, longest, labels = e.shape
        back = np.zeros((n, longest, labels), np.int8)
        stay = np.arange(labels, dtype=np.int8)
        v = self.start + e[:, 0]
        for t in range(1, longest):
            through = v[:, :, None] + self.transitions
            here = mask[:, t][:, None]
            back[:, t] = np.where(here, through.argmax(axis=1), stay)  # past the end the label is carried on
            v = np.where(here, through.max(axis=1) + e[:, t], v)
        path = np.zeros((n, longest), np.int8)
        path[:, -1] = v.argmax(axis=1)
        rows = np.arange(n)
        for t in range(longest - 1, 0, -1):
            path[:, t - 1] = back[rows, t, path[:, t]]
        return path


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def train(features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, categories: list[int], n_labels: int,
          rounds: int = 60, rate: float = 0.15, ridge: float = 1e-3, chunk: int = 32) -> Crf:
    """Maximise the penalised log-likelihood by Adam over all sequences (long ones in chunks)."""
    cut = []
    for n in lengths.tolist():
        cut += [chunk] * (n // chunk) + ([n % chunk] if n % chunk else [])
    lengths = np.array(cut, np.int64)
    offsets = np.cumsum([0, *categories[:-1]])
    at, mask = padded(lengths, int(lengths.max()))
    gold = labels[at]
    flat = features + offsets[None, :]
    size = int(sum(categories))
    model = Crf(np.zeros((size, n_labels)), offsets, np.zeros((n_labels, n_labels)), np.zeros(n_labels))
    eye, n = np.eye(n_labels), len(labels)
    pair_gold = np.zeros((n_labels, n_labels))
    np.add.at(pair_gold, (gold[:, :-1][mask[:, 1:]], gold[:, 1:][mask[:, 1:]]), 1)
    start_gold = eye[gold[:, 0]].sum(axis=0)
    parameters = [model.weights, model.transitions, model.start]
    first = [np.zeros_like(p) for p in parameters]
    second = [np.zeros_like(p) for p in parameters]
    for step in range(1, rounds + 1):
        e = model.emissions(features)[at]
        steps = e.shape[1]
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = model.start + e[:, 0]
        for t in range(1, steps):
            move = _logsum(alpha[:, t - 1][:, :, None] + model.transitions, 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t][:, None], move, alpha[:, t - 1])
        for t in range(steps - 2, -1, -1):
            move = _logsum(model.transitions + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1][:, None], move, 0)
        z = _logsum(alpha[:, -1], 1)
        single = np.exp(alpha + beta - z[:, None, None])
        pair = np.exp(alpha[:, :-1, :, None] + model.transitions + (e + beta)[:, 1:, None, :] - z[:, None, None, None])
        pair = (pair * mask[:, 1:, None, None]).sum(axis=(0, 1))
        off = np.zeros((n, n_labels))
        off[at[mask]] = (eye[gold] - single)[mask]
        g = np.zeros_like(model.weights)
        for t in range(flat.shape[1]):
            for y in range(n_labels):
                g[:, y] += np.bincount(flat[:, t], off[:, y], minlength=size)
        gradients = [g / n - ridge * model.weights, (pair_gold - pair) / n - ridge * model.transitions,
                     (start_gold - single[:, 0].sum(axis=0)) / n - ridge * model.start]
        for p, d, m, s in zip(parameters, gradients, first, second):
            m += 0.1 * (d - m)
            s += 0.01 * (d * d - s)
            p += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
    return model
