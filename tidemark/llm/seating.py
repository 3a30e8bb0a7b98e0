"""Seats in Pitman-Yor restaurants: how many tables the customers of a dish take, drawn from the Gibbs conditional.

All customers of a dish are removed and seated anew together. Given all else, t tables for c customers have weight

    S(c, t) * prod_{m < t} (strength + discount * (rest + m)) * P_m

S is the generalised Stirling number of the discount (ways to seat c customers at t tables, each weighed by the seats), rest
the tables of other dishes in the restaurant, P_m the parent's probability of the dish once m of these tables are its
customers. Up to EXACT customers S comes from its recurrence. Beyond, t is drawn on a grid over the range that holds all
but exp(-DEPTH) of the weight, and S comes from its generating function ((1 - (1 - x)^d) / d)^t / t!: by the integral
along its cut where few customers in a power share a table, else by its saddle point.
"""

from __future__ import annotations

import functools

import numpy as np

EXACT, DEPTH = 1024, 25.0
#: Dishes of up to so many customers are drawn together.
SIZES = (2, 3, 4, 5, 6, 8, 10, 13, 17, 22, 29, 38, 50, 66, 88, 117, 156, 208, 277, 369, 492, 656, 875, EXACT)
#: Points of the grids, step of the integral; up to CUT of t / c^d the integral has no cancellation to speak of.
COARSE, FINE, STEP, CUT = 32, 64, 0.35, 5.0


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function of positive numbers."""
    z, low = x + 7.0, np.ones_like(x)
    for k in range(7):
        low = low * (x + k)
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(low)


@functools.lru_cache(16)
def stirling_table(discount: float) -> np.ndarray:
    """log S(c, t) for c and t up to EXACT."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(EXACT):
        t = np.arange(1, c + 2)
        stay = np.where(t <= c, out[c, t] + np.log(np.maximum(c - discount * t, 1e-300)), -np.inf)
        out[c + 1, t] = np.logaddexp(out[c, t - 1], stay)
    return out


def log_stirling(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log S(c, t) for 1 <= t < c, of many customers."""
    c, t = (np.array(x, dtype=float) for x in np.broadcast_arrays(c, t))
    out, cut = np.zeros(c.shape), t * c**-discount < CUT
    out[cut] = by_integral(c[cut], t[cut], discount)
    out[~cut] = by_saddle(c[~cut], t[~cut], discount)
    return lgamma(c + 1.0) - lgamma(t + 1.0) + out


def by_integral(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log of the coefficient: of the jump at x = 1 + s, integrated over log s."""
    log_v = np.arange(-36.0 / (1 + discount), 4.5, STEP)
    out = np.zeros(len(c))
    for a in range(0, len(c), 4096):
        own, k = slice(a, a + 4096), c[a : a + 4096, None]
        s = np.exp(log_v)[None, :] / k
        inside = np.log1p(-(s**discount) * np.exp(1j * np.pi * discount)) * t[own, None]
        jump = np.exp(inside.real) * np.sin(inside.imag) * np.exp(-(k + 1) * np.log1p(s)) * s
        out[own] = np.log(np.maximum(np.abs(jump.sum(axis=1)) * STEP / np.pi, 1e-300))
    return out - t * np.log(discount)


def by_saddle(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    d = discount
    # log y, y = 1 - x, solves t x d y^(d-1) / (1 - y^d) = c: bisection, as the left side falls from infinity to t.
    low, high = np.full(c.shape, -740.0), np.full(c.shape, -1e-12)
    for _ in range(52):
        s = (low + high) / 2
        more = np.log(t * d * -np.expm1(s)) + (d - 1) * s - np.log(-np.expm1(d * s)) > np.log(c)
        low, high = np.where(more, s, low), np.where(more, high, s)
    s = (low + high) / 2
    x, f = -np.expm1(s), -np.expm1(d * s) / d
    h = x * np.exp((d - 1) * s) / f
    curve = t * (h + x**2 * (1 - d) * np.exp((d - 2) * np.maximum(s, -300)) / f - h**2)
    return t * np.log(f) - c * np.log(x) - 0.5 * np.log(2 * np.pi * np.maximum(curve, 1e-12))


def drawn(c: np.ndarray, rest: np.ndarray, first: np.ndarray, more: np.ndarray | None, over: np.ndarray | None, discount: float, strength: float, u: np.ndarray) -> np.ndarray:
    """Tables of dishes with c customers each; u: a uniform number for each dish. The parent's probability is `first` for
    the first table and (more + m) / (over + m) for those after it; `first` for all of them where more is None."""
    out = np.minimum(c, 1)
    small = np.flatnonzero((c > 1) & (c <= EXACT))
    small = small[np.argsort(c[small].astype(np.uint16), kind="stable")]
    table = stirling_table(discount)
    low = 1
    for high in SIZES:
        own = small[np.searchsorted(c[small], low, side="right") : np.searchsorted(c[small], high, side="right")]
        low = high
        for a in range(0, len(own), step := max(1, 2_000_000 // high)):
            at = own[a : a + step]
            m = np.arange(high)
            logs = np.log(strength + discount * (rest[at, None] + m))
            if more is None:
                logs += np.log(first[at, None])
            else:
                logs[:, 0] += np.log(first[at])
                logs[:, 1:] += np.log((more[at, None] + m[1:]) / (over[at, None] + m[1:]))
            weight = np.cumsum(logs, axis=1) + table[c[at], 1 : high + 1]
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            out[at] = 1 + (weight[:, :-1] < u[at, None] * weight[:, -1:]).sum(axis=1)
    large = np.flatnonzero(c > EXACT)
    for a in range(0, len(large), 4096):
        at = large[a : a + 4096]
        out[at] = drawn_large(c[at].astype(float)[:, None], rest[at, None], first[at, None], *((None, None) if more is None else (more[at, None], over[at, None])), discount, strength, u[at])
    return out


def drawn_large(c: np.ndarray, rest: np.ndarray, first: np.ndarray, more: np.ndarray | None, over: np.ndarray | None, discount: float, strength: float, u: np.ndarray) -> np.ndarray:
    start = strength / discount + rest

    def weight(t: np.ndarray) -> np.ndarray:
        t = np.minimum(t, c - 0.5)
        seats = log_stirling(c, t, discount) + t * np.log(discount) + lgamma(start + t) - lgamma(start)
        if more is None:
            return seats + t * np.log(first)
        return seats + np.log(first) + lgamma(more + t) - lgamma(more + 1) - lgamma(over + t) + lgamma(over + 1)

    grid = np.exp(np.linspace(0, 1, COARSE)[None, :] * np.log(c))
    logs = weight(grid)
    near = logs > logs.max(axis=1, keepdims=True) - DEPTH
    rows = np.arange(len(c))
    low = np.floor(grid[rows, np.maximum(near.argmax(axis=1) - 1, 0)])
    high = np.ceil(grid[rows, np.minimum(COARSE - near[:, ::-1].argmax(axis=1), COARSE - 1)])
    step = np.maximum(1.0, (high - low) / FINE)  # whole numbers where they are few
    logs = weight(low[:, None] + step[:, None] * np.arange(FINE + 1)[None, :])
    total = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
    aim = u * total[:, -1]
    k = np.minimum((total < aim[:, None]).sum(axis=1), FINE)
    below = np.where(k > 0, total[rows, np.maximum(k - 1, 0)], 0.0)
    part = np.where(step > 1, (aim - below) / np.maximum(total[rows, k] - below, 1e-300) - 0.5, 0.0)
    return np.clip(np.rint(low + step * (k + part)), 1, c[:, 0]).astype(np.int64)
