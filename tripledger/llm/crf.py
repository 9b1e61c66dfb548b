"""A linear-chain conditional random field with two labels, over many sequences at once.

Label 0 is the background. A token's features add up to one number, its emission: the
log-odds of label 1 before neighbours count. Sequences are cut into chunks; all chunks advance
together, and the transfer matrices of a sequence's chunks are chained, so the marginals are
exact for texts of any length and the Python loop is as long as one chunk.
"""

from dataclasses import dataclass, field

import numpy as np

CHUNK = 256


@dataclass
class Layout:
    """Where the chunks of a batch of sequences lie in the flat token array."""

    start: np.ndarray  # first token of each chunk
    size: np.ndarray
    sequence: np.ndarray  # which sequence a chunk belongs to
    number: np.ndarray  # its place there
    order: np.ndarray = field(init=False)  # chunks from long to short
    active: np.ndarray = field(init=False)  # chunks with more than t tokens

    def __post_init__(self):
        self.order = np.argsort(-self.size, kind="stable")
        longest = int(self.size.max(initial=0))
        self.active = np.searchsorted(-self.size[self.order], -np.arange(longest), side="left")


def layout(lengths: np.ndarray) -> Layout:
    """Chunks of sequences that follow each other; empty sequences have none."""
    chunks = -(-lengths // CHUNK)
    sequence = np.repeat(np.arange(len(lengths)), chunks)
    first = np.cumsum(lengths) - lengths
    number = np.arange(len(sequence)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    start = first[sequence] + number * CHUNK
    size = np.minimum(CHUNK, lengths[sequence] - number * CHUNK)
    return Layout(start, size, sequence, number)


def marginals(emission: np.ndarray, step: np.ndarray, lay: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, forward, backward): the probability of label 1 at each token, and the ratios
    label 1 : label 0 of the forward and backward messages.

    step: 2 x 2 transition weights, exponentiated. A text starts after a background token.
    """
    x = np.exp(np.clip(emission, -40, 40))
    n = len(lay.size)
    order, start, size = lay.order, lay.start[lay.order], lay.size[lay.order]
    # transfer matrix of each chunk: rows are the label before it, columns its last label
    m = np.zeros((n, 2, 2))
    m[:, 0, 0] = m[:, 1, 1] = 1
    for t, k in enumerate(lay.active):
        a, at = m[:k], x[start[:k] + t]
        c0 = a[:, :, 0] * step[0, 0] + a[:, :, 1] * step[1, 0]
        c1 = (a[:, :, 0] * step[0, 1] + a[:, :, 1] * step[1, 1]) * at[:, None]
        scale = 1 / (c0.sum(1) + c1.sum(1))
        a[:, :, 0], a[:, :, 1] = c0 * scale[:, None], c1 * scale[:, None]
    back = np.empty(n, dtype=np.int64)
    back[order] = np.arange(n)
    m = m[back]
    into, out = np.zeros(n), np.ones(n)  # ratio entering a chunk; backward ratio leaving it
    deepest = int(lay.number.max(initial=0))
    for c in range(1, deepest + 1):
        at = np.flatnonzero(lay.number == c)
        r, before = into[at - 1], m[at - 1]
        into[at] = (before[:, 0, 1] + r * before[:, 1, 1]) / (before[:, 0, 0] + r * before[:, 1, 0])
    for c in range(deepest, 0, -1):
        at = np.flatnonzero(lay.number == c)
        out[at - 1] = (m[at, 1, 0] + m[at, 1, 1] * out[at]) / (m[at, 0, 0] + m[at, 0, 1] * out[at])
    forward, backward = np.empty(len(x)), np.empty(len(x))
    r = into[order]
    for t, k in enumerate(lay.active):
        at = start[:k] + t
        moved = (step[0, 1] + r[:k] * step[1, 1]) / (step[0, 0] + r[:k] * step[1, 0])
        r[:k] = np.clip(x[at] * moved, 1e-200, 1e200)
        forward[at] = r[:k]
    s = out[order].copy()
    for t in range(len(lay.active) - 1, -1, -1):
        k = lay.active[t]
        at = start[:k] + t
        backward[at] = s[:k]
        y = np.clip(x[at] * s[:k], 1e-200, 1e200)
        s[:k] = (step[1, 0] + step[1, 1] * y) / (step[0, 0] + step[0, 1] * y)
    odds = forward * backward
    return odds / (1 + odds), forward, backward


@dataclass
class Model:
    """Weights. Feature rows: 0 is an unknown word, 1 the edge of a text."""

    vocabulary: dict[str, int]
    here: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bias: float
    steps: np.ndarray

    def emission(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        left, right = neighbours(ids, lengths)
        return self.bias + self.here[ids] + self.before[left] + self.after[right]

    def tag(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every token."""
        if not len(ids):
            return np.empty(0)
        return marginals(self.emission(ids, lengths), np.exp(self.steps), layout(lengths))[0]


def neighbours(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids before and after each token, 1 beyond the ends."""
    full = lengths[lengths > 0]
    ends = np.cumsum(full)
    left, right = np.ones_like(ids), np.ones_like(ids)
    left[1:], right[:-1] = ids[:-1], ids[1:]
    left[ends - full] = 1
    right[ends - 1] = 1
    return left, right


def fit(vocabulary: dict[str, int], ids: np.ndarray, labels: np.ndarray, lengths: np.ndarray,
        rounds: int = 40, l2: float = 1.0) -> Model:
    """Weights of greatest penalised likelihood, by resilient gradient steps."""
    size = len(vocabulary) + 2
    left, right = neighbours(ids, lengths)
    lay = layout(lengths)
    full = lengths[lengths > 0]
    first = np.cumsum(full) - full
    came_from = np.concatenate([[0], labels[:-1]])
    came_from[first] = 0
    rate = np.clip(labels.mean(), 1e-6, 0.5)
    weights = np.zeros(3 * size + 1 + 4)
    weights[3 * size] = np.log(rate / (1 - rate))
    seen_steps = np.bincount(2 * came_from + labels, minlength=4)
    width, last = np.full(len(weights), 0.3), np.zeros(len(weights))
    for _ in range(rounds):
        steps = np.clip(weights[3 * size + 1 :], -15, 15).reshape(2, 2)
        e = weights[3 * size] + weights[ids] + weights[size + left] + weights[2 * size + right]
        p, forward, backward = marginals(e, np.exp(steps), lay)
        gap = labels - p
        a, y = np.concatenate([[0.0], forward[:-1]]), np.exp(np.clip(e, -40, 40)) * backward
        a[first] = 0
        w = np.exp(steps)
        all_ways = w[0, 0] + w[0, 1] * y + a * w[1, 0] + a * w[1, 1] * y
        expected = np.array([w[0, 0] * (1 / all_ways).sum(), w[0, 1] * (y / all_ways).sum(),
                             w[1, 0] * (a / all_ways).sum(), w[1, 1] * (a * y / all_ways).sum()])
        gradient = np.concatenate([
            np.bincount(ids, gap, size), np.bincount(left, gap, size), np.bincount(right, gap, size),
            [gap.sum()], seen_steps - expected,
        ]) - l2 * np.where(np.arange(len(weights)) == 3 * size, 0, weights)
        same = np.sign(gradient) * np.sign(last)
        width = np.clip(np.where(same > 0, width * 1.2, np.where(same < 0, width * 0.5, width)), 1e-6, 2)
        gradient = np.where(same < 0, 0, gradient)
        weights = weights + np.sign(gradient) * width
        last = gradient
    steps = np.clip(weights[3 * size + 1 :], -15, 15).reshape(2, 2)
    return Model(vocabulary, weights[:size].copy(), weights[size : 2 * size].copy(),
                 weights[2 * size : 3 * size].copy(), float(weights[3 * size]), steps)
