"""Chinese-restaurant seating under a Pitman-Yor prior, for many dishes at a time.

A restaurant has discount d and concentration theta; its parent serves a dish with
probability p. Given c customers of a dish, and a = theta + d * (tables of the other
dishes), the number t of its tables has the full conditional

    S(c, t) * a * (a + d) * ... * (a + d * (t - 1)) * p ** t

with generalised Stirling numbers S(c + 1, t) = S(c, t - 1) + (c - t * d) * S(c, t). The
predictive probabilities need c and t only, so the customers of a table are summed out,
and a Gibbs step gets all customers of a dish up and draws t anew from this conditional.

The numbers come from the recursion up to ``EXACT`` customers. Beyond, where few tables are
likely they come from their alternating sum, whose terms fall fast there, and elsewhere
from a saddle point; a step costs the same however many customers a dish has.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

#: Customers of a dish up to which Stirling numbers are taken from their recursion.
EXACT = 512
#: Terms of the alternating sum, and the tables (as a multiple of c ** d) up to which it is used.
TERMS, SERIES_MOST = 40, 1.5
#: Numbers of tables that are weighed for a dish; where more are likely, every second, third and so on.
GRID = 129


@lru_cache(maxsize=8)
def log_ratios(d: float) -> np.ndarray:
    """log S(c, t + 1) - log S(c, t) at [c, t], for 1 <= t < c <= EXACT."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    log = np.array([-np.inf, 0.0])
    for c in range(1, EXACT):
        t = np.arange(1, c + 1)
        stay = np.concatenate([[-np.inf], np.log(c - t * d) + log[1:], [-np.inf]])
        log = np.logaddexp(np.concatenate([[-np.inf], log]), stay)
        out[c + 1, 1:c + 1] = np.diff(log[1:])
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0, by Stirling's series behind a shift."""
    x = np.asarray(x, dtype=np.float64)
    product, z = np.ones_like(x), x.copy()
    small = x < 16
    if small.any():
        y = x[small]
        product[small] = np.prod([y + i for i in range(16)], axis=0)
        z[small] += 16
    w = 1 / (z * z)
    series = (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w / 1680))) / z
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + series - np.log(product)


def _log_sum(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log of the coefficient of z**c in (1 - (1 - z)**d)**t over c**(-1 - d), by its alternating sum over binomials."""
    sizes, of = np.unique(c, return_inverse=True)
    # gamma(c + 1) over c ** (1 + d), which all terms are divided by
    scale = log_gamma(sizes + 1) - (1 + d) * np.log(sizes)
    total, choose = np.zeros(len(c)), np.ones(len(c))
    for k in range(1, TERMS + 1):
        choose *= -(t - k + 1) / k
        if abs(k * d - round(k * d)) > 1e-12:  # at whole numbers the reciprocal gamma function is zero
            total += choose * (np.exp(log_gamma(sizes - k * d) - scale) * _reciprocal_gamma(-k * d))[of]
    return np.log(np.maximum(total, 1e-300))


def _reciprocal_gamma(x: float) -> float:
    """1 / gamma(x) for x < 0, by reflection."""
    return math.sin(math.pi * x) / math.pi * math.gamma(1 - x)


def _saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The same coefficient by a saddle point."""
    c, t = np.broadcast_arrays(c, t)
    wanted = np.log(np.maximum(c / t, 1 + 1e-9))
    u = np.minimum(-(wanted - math.log(d)) / (1 - d), -1e-6)  # log of 1 - z
    for _ in range(25):
        value = np.log(-np.expm1(u)) + math.log(d) + (d - 1) * u - np.log(-np.expm1(d * u)) - wanted
        step = value / (-1 / np.expm1(-u) + (d - 1) + d / np.expm1(-d * u))
        u = np.where(u - step < 0, u - step, u / 2)
    z, f = -np.expm1(u), -np.expm1(d * u)
    mean = z * d * np.exp((d - 1) * u) / f
    spread = t * mean * np.maximum(1 + z * (1 - d) / np.exp(u) - mean, 1e-300)
    return t * np.log(f) - c * np.log(z) - 0.5 * np.log(2 * math.pi * spread) + (1 + d) * np.log(c)


def log_stirling(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t) for c > EXACT but for a term of c alone."""
    c, t = np.broadcast_arrays(np.asarray(c, dtype=np.float64), np.asarray(t, dtype=np.float64))
    series = t <= np.minimum(SERIES_MOST * c ** d, 0.3 * c)
    out = np.empty(c.shape)
    out[series] = _log_sum(c[series], t[series], d)
    out[~series] = _saddle(c[~series], t[~series], d)
    return out - log_gamma(t + 1) - t * math.log(d)


def _few(c: np.ndarray, a: np.ndarray, p: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with 2 to EXACT customers."""
    out = np.ones(len(c), dtype=np.int64)
    ratios, u = log_ratios(d), rng.random(len(c))
    order = np.argsort(c, kind="stable")
    sizes, first = np.unique(c[order], return_index=True)
    for size, begin, end in zip(sizes, first, np.append(first[1:], len(c))):
        for at in range(begin, end, 1 << 15):  # bounded rows at once
            rows = order[at:min(end, at + (1 << 15))]
            steps = ratios[size, 1:size] + np.log(a[rows, None] + d * np.arange(1, size)) + np.log(p[rows, None])
            weight = np.concatenate([np.zeros((len(rows), 1)), np.cumsum(steps, axis=1)], axis=1)
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            out[rows] = 1 + (weight < u[rows, None] * weight[:, -1:]).sum(axis=1)
    return out


def _log_law(c: np.ndarray, t: np.ndarray, a: np.ndarray, p: np.ndarray, d: float) -> np.ndarray:
    """log of the conditional of t tables, but for a constant."""
    return log_stirling(c, t, d) + log_gamma(a / d + t) + t * (np.log(p) + math.log(d))


def _many(c: np.ndarray, a: np.ndarray, p: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with more than EXACT customers."""
    low, high = np.ones(len(c)), c.astype(np.float64) - 1
    for _ in range(64):  # the law has one peak: halve until it is found
        if (low >= high).all():
            break
        middle = np.floor((low + high) / 2)
        up = _log_law(c, middle + 1, a, p, d) > _log_law(c, middle, a, p, d)
        low, high = np.where(up, middle + 1, low), np.where(up, high, middle)
    peak = np.clip(low, 2, c - 2.0)
    bend = 2 * _log_law(c, peak, a, p, d) - _log_law(c, peak - 1, a, p, d) - _log_law(c, peak + 1, a, p, d)
    reach = np.ceil(10 / np.sqrt(np.maximum(bend, 1e-12))) + 8
    step = np.ceil((2 * reach + 1) / GRID)
    t = peak[:, None] + step[:, None] * (np.arange(GRID) - GRID // 2)
    inside = (t >= 1) & (t <= c[:, None] - 1)
    rows, columns = np.nonzero(inside)
    law = np.full(t.shape, -np.inf)
    law[rows, columns] = _log_law(c[rows], t[rows, columns], a[rows], p[rows], d)
    weight = np.cumsum(np.exp(law - law.max(axis=1, keepdims=True)), axis=1)
    at = (weight < rng.random(len(c))[:, None] * weight[:, -1:]).sum(axis=1)
    drawn = t[np.arange(len(c)), at] + np.floor((rng.random(len(c)) - 0.5) * step + 0.5)
    return np.clip(drawn, 1, c).astype(np.int64)


def reseat(c: np.ndarray, a: np.ndarray, p: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """One Gibbs step for all dishes: the new numbers of tables of dishes with ``c`` customers."""
    t = np.minimum(c, 1).astype(np.int64)
    few = np.flatnonzero((c > 1) & (c <= EXACT))
    t[few] = _few(c[few], a[few], p[few], d, rng)
    many = np.flatnonzero(c > EXACT)
    for at in range(0, len(many), 512):  # bounded dishes at once
        rows = many[at:at + 512]
        t[rows] = _many(c[rows], a[rows], p[rows], d, rng)
    return t
