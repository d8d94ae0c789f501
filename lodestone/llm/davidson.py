"""Jacobi-Davidson for the largest eigenpairs of a symmetric matrix that is known only by its products with blocks of vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

EPS = np.finfo(float).eps


def orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what `new` adds to orthonormal bases; directions that add nothing go."""
    out = new[:, :0]
    for v in new.T:
        size = np.linalg.norm(v)
        for _ in range(3):
            for b in (*bases, out):
                v = v - b @ (b.T @ v)
        left = np.linalg.norm(v)
        if left > 1e-10 * size and left > 0:
            v = v / left
            for b in (*bases, out):
                v = v - b @ (b.T @ v)
            out = np.column_stack([out, v / np.linalg.norm(v)])
    return out


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, relative: float) -> np.ndarray:
    """MINRES for every column of b by itself; the columns' products are made together, one block a step."""
    x = np.zeros_like(b)
    beta = np.linalg.norm(b, axis=0)
    goal = relative * beta
    some = np.where(beta > 0, beta, 1.0)
    before, v = np.zeros_like(b), b / some
    w2 = w1 = np.zeros_like(b)
    eta, c1, c0, s1, s0 = beta.copy(), np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    last = np.zeros_like(beta)
    open_ = beta > 0
    for _ in range(steps):
        if not open_.any():
            break
        p = np.zeros_like(b)
        p[:, open_] = apply(v[:, open_], np.flatnonzero(open_))
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - last * before
        nxt = np.linalg.norm(p, axis=0)
        delta, r2, r3 = c0 * alpha - c1 * s0 * last, s0 * alpha + c1 * c0 * last, s1 * last
        r1 = np.hypot(delta, nxt)
        ok = open_ & (r1 > 0)
        r1 = np.where(ok, r1, 1.0)
        c, s = delta / r1, nxt / r1
        w = (v - r3 * w2 - r2 * w1) / r1
        x[:, ok] += (c * eta * w)[:, ok]
        eta = np.where(ok, -s * eta, eta)
        w2, w1, c1, c0, s1, s0, last = w1, w, c0, c, s0, s, nxt
        open_ = ok & (np.abs(eta) > goal) & (nxt > EPS * np.abs(alpha))
        before, v = v, p / np.where(nxt > 0, nxt, 1.0)
    return x


def largest(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, inner: int = 8, guards: int = 2, most: int = 200, seed: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues, falling; unit eigenvectors as columns; products with blocks made) of the `wanted` largest pairs.

    A search space gives Ritz pairs; those whose residual is at double precision
    are locked, from the largest on, and deflated. For the others, every round
    solves the correction equations, projected against locked and current
    vectors, by a few MINRES steps in common and adds the solutions to the space.
    """
    wanted = min(wanted, dim)
    block, made = min(dim, wanted + guards), 0

    def times(x: np.ndarray) -> np.ndarray:
        nonlocal made
        made += 1
        return product(x)

    space = orthonormal(np.random.default_rng(seed).standard_normal((dim, block)))
    image = times(space)
    locked, values = np.zeros((dim, 0)), []
    room, short = max(24, 6 * block), 2 * block
    best, idle, scale = np.inf, 0, 0.0
    for _ in range(most):
        h = space.T @ image
        e, s = np.linalg.eigh((h + h.T) / 2)
        e, s = e[::-1], s[:, ::-1]
        space, image = space @ s, image @ s
        scale = max(scale, abs(e[0]), *map(abs, values))
        r = image - e * space
        r -= locked @ (locked.T @ r)
        size = np.linalg.norm(r, axis=0)
        tight = 8 * EPS * np.sqrt(dim) * scale
        need = wanted - len(values)
        worst = size[:need].max()
        idle = 0 if worst < 0.5 * best else idle + 1
        best = min(best, worst)
        if idle >= 4 and best <= 1e4 * EPS * scale:  # rounding errors of the products are reached
            tight = max(tight, 2 * best)
        n = 0
        while n < need and size[n] <= tight:
            n += 1
        if n:
            locked, values = np.column_stack([locked, space[:, :n]]), [*values, *e[:n]]
            space, image, e, r, size = space[:, n:], image[:, n:], e[n:], r[:, n:], size[n:]
            best, idle = np.inf, 0
        if len(values) == wanted:
            order = np.argsort(values)[::-1]
            return np.array(values)[order], locked[:, order], made
        if space.shape[1] + block > room:
            space, image, e, r, size = space[:, :short], image[:, :short], e[:short], r[:, :short], size[:short]
        q = min(space.shape[1], block)
        held = np.column_stack([locked, space[:, :q]])
        away = lambda x: x - held @ (held.T @ x)
        todo = [i for i in range(q) if size[i] > tight]
        theta = e[todo]
        steps = min(inner, dim - held.shape[1])
        solved = minres(lambda x, at: away(times(x) - theta[at] * x), -away(r[:, todo]), steps, 1e-3) if steps > 0 else r[:, todo]
        new = orthonormal(np.column_stack([away(solved)]), locked, space)
        if not new.shape[1]:
            new = orthonormal(np.random.default_rng(seed + made).standard_normal((dim, block)), locked, space)
        if new.shape[1]:
            space, image = np.column_stack([space, new]), np.column_stack([image, times(new)])
    raise ArithmeticError(f"{len(values)} of {wanted} eigenpairs after {most} rounds; residual {best:g}")
