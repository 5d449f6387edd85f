"""A generative model of voters, and a linear classifier on its labels."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np


@dataclass
class LabelModel:
    """Two classes; voters in groups that are independent given the class. A group's table has its joint votes."""

    groups: list[tuple[int, ...]]
    tables: list[np.ndarray]  # [class, joint vote]
    prior: float
    correlations: dict[tuple[int, int], float]
    accuracies: np.ndarray

    def posterior(self, pattern: int) -> float:
        """The probability of class 1 for a pattern of votes, bit k being voter k."""
        logit = np.log(self.prior) - np.log1p(-self.prior)
        for group, probs in zip(self.groups, self.tables, strict=True):
            k = _joint(pattern, group)
            logit += np.log(probs[1, k]) - np.log(probs[0, k])
        return float(1 / (1 + np.exp(-np.clip(logit, -50, 50))))


def _joint(pattern: int, group: tuple[int, ...]) -> int:
    return sum(((pattern >> v) & 1) << i for i, v in enumerate(group))


#: Items that vote for class 1 as a voter is expected to, added to what is counted; they matter in a small corpus only.
EXPECTED = 20.0
BETTER = 2.0


def _em(patterns: np.ndarray, n: np.ndarray, groups: list[tuple[int, ...]], polarity: list[int], start: np.ndarray, rounds: int) -> tuple[list[np.ndarray], np.ndarray, float]:
    joint = [np.array([_joint(int(p), g) for p in patterns]) for g in groups]
    expected = []
    for g in groups:
        e = np.full((2, 1 << len(g)), 0.5)
        e[1, [k for k in range(1 << len(g)) if any(k >> i & 1 and polarity[v] > 0 for i, v in enumerate(g))]] += EXPECTED / (1 << len(g))
        expected.append(e)
    q, prior, tables = start, 0.5, []
    for _ in range(rounds):
        weight = np.stack([n * (1 - q), n * q])
        prior = float(np.clip((weight[1].sum() + 1) / (n.sum() + 2), 1e-6, 0.5))
        tables = []
        for g, j, e in zip(groups, joint, expected, strict=True):
            t = np.stack([np.bincount(j, weights=w, minlength=1 << len(g)) for w in weight]) + e
            t /= t.sum(axis=1, keepdims=True)
            # a voter is better than chance: a vote speaks at least BETTER times as much for its class as for the other
            if polarity[g[0]] < 0:
                t[1, 1:] = np.minimum(t[1, 1:], t[0, 1:] / BETTER)
            else:
                t[1, 1:] = np.maximum(t[1, 1:], t[0, 1:] * BETTER)
            tables.append(t / t.sum(axis=1, keepdims=True))
        logit = np.log(prior) - np.log1p(-prior) + sum(np.log(t[1, j]) - np.log(t[0, j]) for t, j in zip(tables, joint, strict=True))
        q = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
    return tables, q, prior


def fit_label_model(counts: dict[int, int], polarity: list[int], prior: float = 0.02, rounds: int = 60, correlated: float = 0.15) -> LabelModel:
    """Accuracies and correlations of voters from the numbers of items by pattern of votes, without labels.

    EM starts from the balance of votes for and against (`polarity` of each voter). With voters independent given the
    class, the votes of a pair that come together oftener or more seldom in a class than the model says are a
    correlation; voters correlated beyond `correlated` form groups of at most three of one polarity, whose joint votes get a table of
    their own, and EM runs again. No items: a model that holds nothing to be of class 1.
    """
    if not counts:
        counts = {0: 1}
    patterns = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[int(p)] for p in patterns], dtype=np.float64)
    votes = (patterns[:, None] >> np.arange(len(polarity))) & 1
    pol = np.array(polarity)
    balance = votes[:, pol > 0].sum(axis=1) - votes[:, pol < 0].sum(axis=1)  # the majority of votes, every vote alike
    start = 1 / (1 + np.exp(-2.0 * balance))
    start = np.where(votes[:, pol > 0].any(axis=1), start, prior / 50)
    single = [(v,) for v in range(len(polarity))]
    _, q, _ = _em(patterns, n, single, polarity, start, 8)
    correlations: dict[tuple[int, int], float] = {}
    for a, b in combinations(range(len(polarity)), 2):
        worst = 0.0
        for w in (n * q, n * (1 - q)):
            total = w.sum()
            if total < 20:
                continue
            pa, pb, pab = (w @ votes[:, a]) / total, (w @ votes[:, b]) / total, (w @ (votes[:, a] * votes[:, b])) / total
            scale = np.sqrt(pa * (1 - pa) * pb * (1 - pb))
            if scale > 1e-6:
                worst = max(worst, abs(pab - pa * pb) / scale)
        correlations[a, b] = worst
    groups: list[set[int]] = [{v} for v in range(len(polarity))]
    for (a, b), c in sorted(correlations.items(), key=lambda x: -x[1]):
        if c < correlated:
            break
        ga, gb = next(g for g in groups if a in g), next(g for g in groups if b in g)
        if ga is not gb and len(ga) + len(gb) <= 3 and polarity[a] == polarity[b]:
            groups.remove(gb)
            ga |= gb
    final = [tuple(sorted(g)) for g in groups]
    tables, q, share = _em(patterns, n, final, polarity, start, rounds if len(patterns) > 1 else 1)
    sure = n * np.where(q > 0.5, q, 1 - q)
    accuracy = np.array([(sure @ (votes[:, v] * ((q > 0.5) == (polarity[v] > 0)))) / max(1e-9, sure @ votes[:, v]) for v in range(len(polarity))])
    return LabelModel(final, tables, share, correlations, accuracy)


def fit_linear(features: list[np.ndarray], labels: np.ndarray, buckets: int, rounds: int = 30, rate: float = 0.5, decay: float = 1e-6, seed: int = 3) -> np.ndarray:
    """Logistic regression on bags of buckets, by AdaGrad on soft labels; the bias is the last weight.

    A bag counts by the root of its size. Rows of class 0 weigh twice. Without rows the bias says no.
    """
    w, g = np.zeros(buckets + 1), np.full(buckets + 1, 1e-8)
    if not len(labels):
        w[-1] = -10.0
        return w
    cost = np.where(labels > 0.5, 1.0, 2.0)
    rng = np.random.default_rng(seed)
    sizes = np.array([len(f) for f in features])
    flat, at = np.concatenate(features), np.append(0, np.cumsum(sizes))
    batches = max(1, len(labels) // 256)
    for _ in range(max(rounds, -(-rounds * 10 // batches))):  # few batches go round more often
        for batch in np.array_split(rng.permutation(len(labels)), batches):
            idx = np.concatenate([flat[at[i] : at[i + 1]] for i in batch])
            row = np.repeat(np.arange(len(batch)), sizes[batch])
            scale = 1 / np.sqrt(np.maximum(sizes[batch], 1))
            z = np.bincount(row, weights=w[idx], minlength=len(batch)) * scale + w[-1]
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) * cost[batch]
            grad_rows = (err * scale)[row]
            touched, inverse = np.unique(idx, return_inverse=True)
            grad = np.bincount(inverse, weights=grad_rows) / len(batch) + decay * w[touched]
            g[touched] += grad * grad
            w[touched] -= rate * grad / np.sqrt(g[touched])
            bias = err.mean()
            g[-1] += bias * bias
            w[-1] -= rate * bias / np.sqrt(g[-1])
    return w
