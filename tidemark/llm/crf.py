"""A two-tag linear-chain conditional random field on numpy, many short chains at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Tokens of a chain; a document is cut into chains of this length.
CHAIN = 64


def _plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


@dataclass
class Chain:
    """Scores of the tags 0 (fine) and 1 (toxic); those of tag 0 and of staying at 0 are 0."""

    enter: float = -1.0  # 0 to 1
    leave: float = 0.0  # 1 to 0
    stay: float = 0.0  # 1 to 1
    start: float = 0.0

    def marginals(self, emissions: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By forward-backward, for rows of ``emissions`` (scores of tag 1) of which ``lengths`` entries count.

        Log normaliser of each row, probability of tag 1 at each place, and the expected number of moves
        (0 to 1, 1 to 0, 1 to 1).
        """
        rows, steps = emissions.shape
        fine, toxic = np.zeros((steps, rows)), np.zeros((steps, rows))
        toxic[0] = emissions[:, 0] + self.start
        for t in range(1, steps):
            on = t < lengths
            fine[t] = np.where(on, _plus(fine[t - 1], toxic[t - 1] + self.leave), fine[t - 1])
            toxic[t] = np.where(on, _plus(fine[t - 1] + self.enter, toxic[t - 1] + self.stay) + emissions[:, t], toxic[t - 1])
        normal = _plus(fine[-1], toxic[-1])
        after_fine, after_toxic = np.zeros(rows), np.zeros(rows)
        found = np.zeros((rows, steps))
        moves = np.zeros((rows, 3))
        for t in range(steps - 1, -1, -1):
            found[:, t] = np.where(t < lengths, np.exp(toxic[t] + after_toxic - normal), 0)
            if not t:
                break
            on = t < lengths
            here = emissions[:, t] + after_toxic
            moves[:, 0] += np.where(on, np.exp(fine[t - 1] + self.enter + here - normal), 0)
            moves[:, 1] += np.where(on, np.exp(toxic[t - 1] + self.leave + after_fine - normal), 0)
            moves[:, 2] += np.where(on, np.exp(toxic[t - 1] + self.stay + here - normal), 0)
            after_fine, after_toxic = (
                np.where(on, _plus(after_fine, self.enter + here), after_fine),
                np.where(on, _plus(self.leave + after_fine, self.stay + here), after_toxic),
            )
        return normal, found, moves


def train(
    features: list[tuple[np.ndarray, np.ndarray, np.ndarray]],
    size: int,
    tags: np.ndarray,
    lengths: np.ndarray,
    rounds: int = 150,
    rate: float = 0.1,
    decay: float = 1e-3,
) -> tuple[np.ndarray, Chain]:
    """Weights of ``size`` features of tag 1, and the chain, that make ``tags`` likely.

    ``features`` lists (row, place, feature) triples that add their weight to a place's score. Adam on the
    penalised log-likelihood; no chance is involved.
    """
    row, place, feature = (np.concatenate(x) for x in zip(*features))
    rows, steps = tags.shape
    inside = np.arange(steps) < lengths[:, None]
    tags = tags * inside
    moved = np.stack(
        [
            ((tags[:, :-1] == a) & (tags[:, 1:] == b) & inside[:, 1:]).sum(axis=1)
            for a, b in ((0, 1), (1, 0), (1, 1))
        ],
        1,
    )
    values = np.zeros(size + 4)
    values[size:] = (-1.0, 0.0, 0.0, 0.0)
    first, second = np.zeros_like(values), np.zeros_like(values)
    for step in range(1, rounds + 1):
        chain = Chain(*values[size:])
        emissions = np.zeros((rows, steps))
        np.add.at(emissions, (row, place), values[feature])
        _, found, moves = chain.marginals(emissions, lengths)
        miss = tags - found
        gradient = np.empty_like(values)
        gradient[:size] = np.bincount(feature, miss[row, place], size)
        gradient[size : size + 3] = (moved - moves).sum(axis=0)
        gradient[size + 3] = miss[:, 0].sum()
        gradient = gradient / rows - decay * values
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        values += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return values[:size], Chain(*map(float, values[size:]))
