"""NumPy helpers that run inside Spark tasks, one bounded block of entities at a time.

The update of one entity (a user or an item) with vector x, observed counterpart vectors v,
observed coefficient ``coef = w - n*c``, target ``wr`` and missing-data matrix ``scale * S`` is

    A = scale*S + sum(coef * v v^T) + lam*I          b = sum(wr * v)

``sweep`` is one Gauss-Seidel pass over A x = b; ``solve`` is its exact solution.
"""

from __future__ import annotations

import numpy as np

# Entities, and padded vector elements, that one batched solve takes.
SOLVE_BATCH = 256
SOLVE_CELLS = 1 << 21


def check_positive(values: np.ndarray) -> None:
    if not (values > 0).all():
        raise ValueError(
            "non-positive denominator: repeated pairs with confidence above one make the "
            "objective unbounded; use on_duplicate='distinct' or a smaller c0"
        )


def check_finite(values: np.ndarray) -> None:
    if not np.isfinite(values).all():
        raise ValueError("factors are not finite: the model has diverged")


def ragged_starts(lengths: np.ndarray) -> np.ndarray:
    starts = np.zeros(len(lengths), dtype=np.int64)
    np.cumsum(lengths[:-1], out=starts[1:])
    return starts


def sweep(x, vectors, at, lengths, coef, wr, scale, cache, lam):
    """One element-wise pass over many entities at once; changes and returns ``x``.

    ``vectors``: (K, m), one column per distinct counterpart.  ``at``: its column for each
    observation; observations are grouped by entity, ``lengths`` long.  The residual form never
    builds A, so the cost is K per observation and K*K per entity.
    """
    starts = ragged_starts(lengths)
    entity = np.repeat(np.arange(len(lengths)), lengths)
    # What is left to explain: wr - coef * prediction.
    left = wr.copy()
    if x.any():
        predicted = np.zeros(len(at))
        for f in range(len(cache)):
            predicted += x[:, f].take(entity) * vectors[f].take(at)
        left -= coef * predicted
    for f in range(len(cache)):
        v = vectors[f].take(at).astype(np.float64, copy=False)
        wv = coef * v
        old = x[:, f].copy()
        observed = np.add.reduceat(wv * v, starts)
        v *= left
        top = np.add.reduceat(v, starts) + old * observed
        top -= scale * (x @ cache[:, f] - old * cache[f, f])
        bottom = observed + scale * cache[f, f] + lam
        check_positive(bottom)
        x[:, f] = top / bottom
        wv *= (x[:, f] - old).take(entity)
        left -= wv
    check_finite(x)
    return x


def normal_equations(vectors, at, coef, wr):
    """Observed part of A and b for one entity, or for one chunk of a large one."""
    v = vectors[:, at].astype(np.float64, copy=False)
    return (v * coef) @ v.T, v @ wr


def sweep_systems(x, a, b):
    """One Gauss-Seidel pass over a batch of full systems ``a`` (n,K,K), ``b`` (n,K)."""
    for f in range(a.shape[1]):
        diagonal = a[:, f, f]
        check_positive(diagonal)
        rest = np.einsum("nk,nk->n", a[:, f, :], x) - diagonal * x[:, f]
        x[:, f] = (b[:, f] - rest) / diagonal
    check_finite(x)
    return x


def solve(vectors, at, lengths, coef, wr, scale, cache, lam):
    """Exact solution per entity, by batched products over entities of similar length.

    Entities are taken by falling length and padded with weight zero to the longest of their
    batch.  A batch holds at most ``SOLVE_CELLS`` padded vector elements.
    """
    k = len(cache)
    starts = ragged_starts(lengths)
    out = np.empty((len(lengths), k))
    ridge = lam * np.eye(k)
    order = np.argsort(-lengths, kind="stable")
    low = 0
    while low < len(order):
        longest = max(1, int(lengths[order[low]]))
        count = max(1, min(SOLVE_BATCH, SOLVE_CELLS // (longest * k)))
        some = order[low : low + count]
        low += count
        steps = np.arange(longest)
        real = steps < lengths[some][:, None]
        places = np.where(real, starts[some][:, None] + steps, 0)
        v = vectors.T[at[places]].astype(np.float64, copy=False)  # entity, observation, factor
        weighted = v * np.where(real, coef[places], 0.0)[:, :, None]
        a = weighted.transpose(0, 2, 1) @ v + scale[some][:, None, None] * cache + ridge
        b = np.einsum("nmk,nm->nk", v, np.where(real, wr[places], 0.0))
        out[some] = np.linalg.solve(a, b[:, :, None])[:, :, 0]
    check_finite(out)
    return out


def triangle(k: int) -> int:
    return k * (k + 1) // 2


def pack(a: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Upper triangle of ``a``, then the other vectors."""
    return np.concatenate([a[np.triu_indices(len(a))], *more])


def symmetric(rows: np.ndarray, k: int) -> np.ndarray:
    """A batch of matrices from their upper triangles."""
    upper = np.triu_indices(k)
    a = np.zeros((len(rows), k, k))
    a[:, upper[0], upper[1]] = rows
    a[:, upper[1], upper[0]] = rows
    return a


def unpack(rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrices and right-hand sides of a batch of packed systems."""
    return symmetric(rows[:, : triangle(k)], k), rows[:, triangle(k) :]
