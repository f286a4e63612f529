"""Small numerical routines for sufficient statistics on the driver (numpy and the standard library only)."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(x, dtype=float)))


def logit(p: np.ndarray, edge: float = 1e-12) -> np.ndarray:
    q = np.clip(np.asarray(p, dtype=float), edge, 1 - edge)
    return np.log(q / (1 - q))


def chi2_tail(x: float, df: float) -> float:
    """P(X >= x) of a chi-squared variable, by the regularised incomplete gamma function."""
    if df <= 0 or math.isnan(x):
        return math.nan
    if x <= 0:
        return 1.0
    a, z = df / 2, x / 2
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - front * total)
    b = z + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return min(1.0, front * h)


def newton_logistic(sums: Callable[[float, float], tuple[float, np.ndarray, np.ndarray]], total: float, hits: float, steps: int = 100) -> tuple[float, float]:
    """Intercept and slope by Newton's method with step halving. ``sums`` gives loss, downward gradient and Hessian at an intercept and a slope."""
    beta = np.array([float(logit(hits / total, 1e-9)), 0.0])
    now, g, h = sums(*beta)
    for _ in range(steps):
        if np.linalg.cond(h) > 1e14:
            break
        step = np.linalg.solve(h, g)
        size = 1.0
        after = sums(*(beta + step))
        while size > 1e-8 and not after[0] <= now:
            size /= 2
            after = sums(*(beta + size * step))
        beta = beta + size * step
        done = abs(now - after[0]) <= 1e-13 * (abs(now) + 1) and size == 1.0 and np.abs(step).max() < 1e-10
        now, g, h = after
        if done:
            break
    return float(beta[0]), float(beta[1])


def shift_of(sums: Callable[[float], tuple[float, float]]) -> float:
    """The root, within 100 of 0, of a decreasing function that ``sums`` gives with its slope: Newton's method, kept between bounds."""
    low, high, a = -100.0, 100.0, 0.0
    for _ in range(200):
        value, slope = sums(a)
        if value > 0:
            low = a
        else:
            high = a
        after = a - value / slope if slope < 0 else (low + high) / 2
        if not low <= after <= high:
            after = (low + high) / 2
        if value == 0 or abs(after - a) < 1e-13 * max(1.0, abs(a)):
            return after
        a = after
    return a


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Nondecreasing weighted least-squares fit, by pooling adjacent violators."""
    value, weight, size = [], [], []
    for a, b in zip(y.tolist(), w.tolist(), strict=True):
        value.append(a)
        weight.append(b)
        size.append(1)
        while len(value) > 1 and value[-2] >= value[-1]:
            total = weight[-2] + weight[-1]
            value[-2:] = [(value[-2] * weight[-2] + value[-1] * weight[-1]) / total]
            weight[-2:] = [total]
            size[-2:] = [size[-2] + size[-1]]
    return np.repeat(value, size)


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, *, steps: int = 3000, memory: int = 20, tolerance: float = 1e-11) -> tuple[np.ndarray, float, bool]:
    """L-BFGS with a backtracking line search; ``f`` gives value and gradient (inf outside its domain)."""
    x = start.astype(float)
    value, gradient = f(x)
    s_list: list[np.ndarray] = []
    y_list: list[np.ndarray] = []
    still = 0
    for _ in range(steps):
        q = gradient.copy()
        alphas = []
        for s, y in zip(reversed(s_list), reversed(y_list), strict=True):
            a = s @ q / (y @ s)
            q -= a * y
            alphas.append(a)
        if s_list:
            q *= (s_list[-1] @ y_list[-1]) / (y_list[-1] @ y_list[-1])
        for (s, y), a in zip(zip(s_list, y_list, strict=True), reversed(alphas), strict=True):
            q += s * (a - y @ q / (y @ s))
        direction = -q
        slope = gradient @ direction
        if slope >= 0:
            direction, slope = -gradient, -(gradient @ gradient)
            s_list, y_list = [], []
        size = 1.0 if s_list else min(1.0, 1.0 / max(np.abs(gradient).sum(), 1e-12))
        while True:
            trial, after_gradient = f(x + size * direction)
            if np.isfinite(trial) and trial <= value + 1e-4 * size * slope:
                break
            size /= 2
            if size < 1e-20:
                return x, value, bool(np.abs(gradient).max() < 1e-3 * max(1.0, abs(value)))
        step, change = size * direction, after_gradient - gradient
        if step @ change > 1e-12 * np.linalg.norm(step) * np.linalg.norm(change):
            s_list.append(step)
            y_list.append(change)
            if len(s_list) > memory:
                s_list.pop(0)
                y_list.pop(0)
        x = x + step
        still = still + 1 if value - trial <= tolerance * max(1.0, abs(value)) else 0
        value, gradient = trial, after_gradient
        if np.abs(gradient).max() < 1e-7 * max(1.0, abs(value)) or still >= 5:
            return x, value, True
    return x, value, False
