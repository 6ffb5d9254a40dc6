"""A linear-chain conditional random field in numpy: batched training and Viterbi over token lines.

A token's own features (shape, length, kinds of characters, known words) also serve its neighbours: token i sees those
of i, i-1, i-2, i-3, i+1 and i+2, and features of its file. Weights come from gradient ascent on the likelihood of a small
labelled table. Decoding gathers one score vector for each distinct token, so that work in Python is by distinct token.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

#: Own token first, then three before it and two after it.
OFFSETS = (0, -1, -2, -3, 1, 2)
_RUNS = re.compile(r"X+|x+|d+")


def token_features(token: str) -> list[str]:
    n = len(token)
    if n == 1 and not token.isalnum():
        return [f"p={token}"]
    plain = "".join("d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c for c in token)
    shape = _RUNS.sub(lambda m: m[0][0], plain)
    digits, upper, letters = plain.count("d"), plain.count("X"), plain.count("X") + plain.count("x")
    size = n if n < 5 else 5 if n < 8 else 8 if n < 12 else 12 if n < 16 else 16 if n < 20 else 20 if n < 32 else 32
    kind = "digits" if digits == n else "letters" if not digits and letters == n else "mixed" if digits and letters else "other"
    turns = sum(a != b for a, b in zip(plain, plain[1:], strict=False))
    lead = [f"z={'0' if token[0] == '0' else '1'},{min(n, 12)}"] if kind == "digits" else []
    return lead + [f"s={shape if len(shape) <= 6 else 'long'}", f"k={kind},{size}", f"t={kind},{min(turns // 3, 4)}", f"u={bool(upper) and upper < letters},{kind}", f"w={token.lower()}" if n <= 14 and kind != "digits" else "w="]


@dataclass
class Crf:
    labels: list[str]
    known: dict[str, int]
    weights: np.ndarray  # offset x feature x label
    steps: np.ndarray  # label x label
    file_weights: np.ndarray  # file feature x label
    _rows: dict[str, int] = field(default_factory=dict)
    _scores: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_rows": {}, "_scores": None}

    def _vector(self, token: str | None) -> np.ndarray:
        ids = [self.known[f] for f in (token_features(token) if token is not None else ["edge"]) if f in self.known]
        return self.weights[:, ids].sum(axis=1)

    def _table(self, tokens: list[str]) -> np.ndarray:
        """Row numbers of tokens; row 0 is what lies beyond a line."""
        if self._scores is None or len(self._rows) > 200_000:
            self._rows, self._scores = {}, self._vector(None)[None].copy()
        new = [t for t in dict.fromkeys(tokens) if t not in self._rows]
        if new:
            first = len(self._scores)
            self._rows.update(zip(new, range(first, first + len(new)), strict=True))
            self._scores = np.concatenate([self._scores, np.stack([self._vector(t) for t in new])])
        return np.fromiter(map(self._rows.__getitem__, tokens), dtype=np.int64, count=len(tokens))

    def decode(self, lines: list[list[str]], files: np.ndarray) -> list[np.ndarray]:
        """The best labels of each line; ``files`` has a row of file features for each line. A line is an independent sequence."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int8)] * len(lines)
        order = sorted((k for k in range(len(lines)) if lines[k]), key=lambda k: len(lines[k]))
        i = 0
        while i < len(order):
            longest, j = len(lines[order[i]]), i
            while j < len(order) and (j - i + 1) * len(lines[order[j]]) <= max(40_000, longest) and len(lines[order[j]]) <= 2 * longest + 8:
                j += 1
            j = max(j, i + 1)
            batch = order[i:j]
            for k, best in zip(batch, self._viterbi([lines[k] for k in batch], files[batch]), strict=True):
                out[k] = best
            i = j
        return out

    def _viterbi(self, lines: list[list[str]], files: np.ndarray) -> list[np.ndarray]:
        sizes = np.array([len(x) for x in lines])
        flat = self._table([t for x in lines for t in x])
        most, pad = int(sizes.max()), 3
        grid = np.zeros((len(lines), most + 2 * pad), dtype=np.int64)
        inside = np.arange(most)[None, :] < sizes[:, None]
        grid[:, pad : pad + most][inside] = flat
        score = (files @ self.file_weights)[:, None, :] + sum(self._scores[:, k][grid[:, pad + o : pad + o + most]] for k, o in enumerate(OFFSETS))
        back = np.zeros((most, len(lines), len(self.labels)), dtype=np.int8)
        best = score[:, 0] + self.steps[0][None]
        for t in range(1, most):
            paths = best[:, :, None] + self.steps[None]
            back[t] = paths.argmax(axis=1)
            best = np.where(inside[:, t, None], paths.max(axis=1) + score[:, t], best)
        last = (best + self.steps[:, 0][None]).argmax(axis=1)
        labels = np.zeros((len(lines), most), dtype=np.int8)
        rows = np.arange(len(lines))
        for t in range(most - 1, -1, -1):
            labels[:, t] = np.where(inside[:, t], last, 0)
            if t:
                last = np.where(inside[:, t], back[t, rows, last], last)
        return [labels[k, :n] for k, n in enumerate(sizes.tolist())]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class _Batch:
    """Lines of like length, with the places and (offset, feature) numbers of all features that are on."""

    def __init__(self, rows: list[tuple[list[str], list[int], list[float]]], known: dict[str, int], n_labels: int) -> None:
        self.size, self.most = len(rows), max(len(t) for t, _, _ in rows)
        self.files = np.array([f for _, _, f in rows])
        sizes = np.array([len(t) for t, _, _ in rows])
        self.ends, self.inside = sizes - 1, np.arange(self.most)[None, :] < sizes[:, None]
        gold, at, key = np.zeros((self.size, self.most), dtype=np.int64), [], []
        for r, (tokens, ys, _) in enumerate(rows):
            gold[r, : len(ys)] = ys
            own = [[known[f] for f in token_features(t) if f in known] for t in tokens]
            for i in range(len(tokens)):
                for k, o in enumerate(OFFSETS):
                    for f in own[i + o] if 0 <= i + o < len(tokens) else [known["edge"]]:
                        at.append(r * self.most + i)
                        key.append(k * len(known) + f)
        self.at, self.key = np.array(at), np.array(key)
        self.hot = np.eye(n_labels)[gold] * self.inside[..., None]
        self.gold_steps = np.zeros((n_labels, n_labels))
        np.add.at(self.gold_steps, (0, gold[:, 0]), 1)
        np.add.at(self.gold_steps, (gold[np.arange(self.size), self.ends], 0), 1)
        for t in range(1, self.most):
            live = self.inside[:, t]
            np.add.at(self.gold_steps, (gold[live, t - 1], gold[live, t]), 1)

    def gradients(self, w: np.ndarray, steps: np.ndarray, fw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the log-likelihood, by forward and backward sums."""
        b, most, n_labels, inside, rows = self.size, self.most, len(steps), self.inside, np.arange(self.size)
        e = np.stack([np.bincount(self.at, weights=w[self.key, y], minlength=b * most) for y in range(n_labels)], axis=1).reshape(b, most, n_labels) + (self.files @ fw)[:, None]
        fwd, bwd = np.zeros((b, most, n_labels)), np.zeros((b, most, n_labels))
        fwd[:, 0] = e[:, 0] + steps[0]
        for t in range(1, most):
            fwd[:, t] = np.where(inside[:, t, None], _lse(fwd[:, t - 1, :, None] + steps[None], 1) + e[:, t], fwd[:, t - 1])
        bwd[:, most - 1] = steps[:, 0]
        for t in range(most - 2, -1, -1):
            step = _lse(steps[None] + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            bwd[:, t] = np.where(inside[:, t + 1, None], step, steps[:, 0][None])
        z = _lse(fwd[rows, self.ends] + steps[:, 0], 1)
        marginal = np.exp(np.minimum(fwd + bwd - z[:, None, None], 0)) * inside[..., None]
        expected = np.zeros_like(steps)
        expected[0] += marginal[:, 0].sum(axis=0)
        expected[:, 0] += marginal[rows, self.ends].sum(axis=0)
        for t in range(1, most):
            pair = np.exp(np.minimum(fwd[:, t - 1, :, None] + steps[None] + (e[:, t] + bwd[:, t])[:, None, :] - z[:, None, None], 0)) * inside[:, t, None, None]
            expected += pair.sum(axis=0)
        diff = self.hot - marginal
        flat = diff.reshape(-1, n_labels)
        gw = np.stack([np.bincount(self.key, weights=flat[self.at, y], minlength=len(w)) for y in range(n_labels)], axis=1)
        return gw, self.gold_steps - expected, self.files.T @ diff.sum(axis=1)


def train(labels: list[str], table: list[tuple[list[str], list[int], list[float]]], rounds: int = 20, rate: float = 0.4, decay: float = 1e-3, forbidden: list[tuple[int, int]] = (), batch: int = 96) -> Crf:
    """``table``: tokens, label numbers and file features of each line. Label 0 is outside. Adagrad on the likelihood,
    in ``rounds`` passes over batches of lines of like length; the order is fixed by a seed."""
    seen = Counter(f for tokens, _, _ in table for t in tokens for f in token_features(t))
    known = {f: i for i, f in enumerate([f for f, n in seen.items() if n >= 3 or not f.startswith("w=")] + ["edge"])}
    n_labels, rng = len(labels), np.random.default_rng(3)
    by_size = sorted(table, key=lambda x: len(x[0]))
    batches = [_Batch(by_size[i : i + batch], known, n_labels) for i in range(0, len(by_size), batch)]
    w, steps, fw = np.zeros((len(OFFSETS) * len(known), n_labels)), np.zeros((n_labels, n_labels)), np.zeros((batches[0].files.shape[1], n_labels))
    for a, c in forbidden:
        steps[a, c] = -1e4
    held = steps < -1e3
    memory = [np.full_like(x, 1e-6) for x in (w, steps, fw)]
    for _ in range(rounds):
        for k in rng.permutation(len(batches)).tolist():
            x = batches[k]
            for y, g, m in zip((w, steps, fw), x.gradients(w, steps, fw), memory, strict=True):
                g = g - decay * x.size * y
                if y is steps:
                    g = np.where(held, 0, g)
                m += g * g
                y += rate * g / np.sqrt(m)
    return Crf(labels, known, w.reshape(len(OFFSETS), len(known), n_labels), steps, fw)


def runs(labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(begin label, first token, last token) of each span; odd labels begin a kind, the even label after one continues it."""
    out, k = [], 0
    where = np.flatnonzero(labels)
    while k < len(where):
        i = int(where[k])
        y = int(labels[i])
        if y % 2 == 0:
            k += 1
            continue
        j = i
        while j + 1 < len(labels) and labels[j + 1] == y + 1:
            j += 1
        out.append((y, i, j))
        while k < len(where) and where[k] <= j:
            k += 1
    return out
