"""A linear-chain conditional random field over hashed binary features, trained in numpy, decoded by Viterbi."""

from __future__ import annotations

import zlib
from functools import lru_cache

SIZE = 1 << 13


@lru_cache(maxsize=1 << 16)
def slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) % SIZE


class ChainCRF:
    """Labels 0 .. n_labels-1; a sequence is a list of lists of feature slots."""

    def __init__(self, n_labels: int = 2):
        import numpy as np

        self.w = np.zeros((SIZE, n_labels))
        self.step = np.zeros((n_labels, n_labels))
        self.start = np.zeros(n_labels)

    def scores(self, sequence):
        import numpy as np

        return np.array([self.w[f].sum(axis=0) for f in sequence])

    def marginals(self, emit):
        """Marginals of single labels and of neighbouring labels, by forward-backward in log space."""
        import numpy as np

        n, k = emit.shape
        fore, back = np.empty((n, k)), np.zeros((n, k))
        fore[0] = self.start + emit[0]
        for i in range(1, n):
            fore[i] = np.logaddexp.reduce(fore[i - 1][:, None] + self.step, axis=0) + emit[i]
        for i in range(n - 2, -1, -1):
            back[i] = np.logaddexp.reduce(self.step + (emit[i + 1] + back[i + 1])[None, :], axis=1)
        log_z = np.logaddexp.reduce(fore[-1])
        single = np.exp(fore + back - log_z)
        pair = np.exp(fore[:-1, :, None] + self.step[None] + (emit[1:] + back[1:])[:, None, :] - log_z) if n > 1 else np.zeros((0, k, k))
        return single, pair

    def train(self, data, epochs: int = 6, rate: float = 0.2, l2: float = 1e-4, seed: int = 3) -> ChainCRF:
        """data: [(sequence, labels)]. Stochastic gradient ascent of the conditional log-likelihood."""
        import numpy as np

        data = [(s, np.array(y)) for s, y in data if len(s)]
        rng, done, steps = np.random.default_rng(seed), 0, epochs * len(data)
        for _ in range(epochs):
            for i in rng.permutation(len(data)):
                sequence, y = data[i]
                r = rate / (1 + 4 * done / steps)
                done += 1
                single, pair = self.marginals(self.scores(sequence))
                single = -single
                single[np.arange(len(y)), y] += 1
                for f, g in zip(sequence, single, strict=True):
                    self.w[f] += r * g - r * l2 * self.w[f]
                self.start += r * single[0]
                if len(y) > 1:
                    seen = np.zeros_like(self.step)
                    np.add.at(seen, (y[:-1], y[1:]), 1)
                    self.step += r * (seen - pair.sum(axis=0))
        return self

    def decode(self, sequence) -> list[int]:
        """The likeliest labels (Viterbi); ties go to the smaller label. Plain floats: sequences are long and labels few."""
        if not sequence:
            return []
        emit = self.scores(sequence).tolist()
        step, labels = self.step.tolist(), range(len(self.start))
        best, came = [s + e for s, e in zip(self.start.tolist(), emit[0], strict=True)], []
        for e in emit[1:]:
            froms = [max(labels, key=lambda a, b=b: best[a] + step[a][b]) for b in labels]
            best = [best[a] + step[a][b] + e[b] for b, a in enumerate(froms)]
            came.append(froms)
        out = [max(labels, key=lambda b: best[b])]
        for froms in reversed(came):
            out.append(froms[out[-1]])
        return out[::-1]
