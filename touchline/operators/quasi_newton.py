"""Minimum of a smooth function within bounds: limited-memory quasi-Newton steps over the variables that are free to move."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np


def _direction(g: np.ndarray, pairs: deque) -> np.ndarray:
    """Two-loop product of the inverse curvature with a gradient."""
    q, held = g.copy(), []
    for s, y in reversed(pairs):
        a = (s @ q) / (s @ y)
        q -= a * y
        held.append(a)
    if pairs:
        s, y = pairs[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(pairs, reversed(held)):
        q += (a - (y @ q) / (s @ y)) * s
    return q


def bounded_minimum(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 500, memory: int = 12, tol: float = 1e-8) -> tuple[np.ndarray, float]:
    """(argument, value) where ``f`` (value and gradient) is least between ``low`` and ``high``.

    A variable at a bound that its gradient pushes against stands still for the step; a step is projected onto the bounds and
    halved until it descends enough.  Ends when the projected gradient is below ``tol`` of the value's scale.
    """
    x = np.clip(start, low, high)
    value, g = f(x)
    pairs: deque = deque(maxlen=memory)
    for _ in range(steps):
        if np.abs(np.clip(x - g, low, high) - x).max() <= tol * max(1.0, abs(value)):
            break
        free = ~(((x <= low) & (g > 0)) | ((x >= high) & (g < 0)))
        d = np.where(free, -_direction(np.where(free, g, 0.0), pairs), 0.0)
        if d @ g >= 0:
            pairs.clear()
            d = np.where(free, -g, 0.0)
        step = 1.0 if pairs else min(1.0, 1.0 / np.abs(d).max())
        while True:
            nxt = np.clip(x + step * d, low, high)
            new, slope = f(nxt)
            if np.isfinite(new) and new <= value + 1e-4 * (g @ (nxt - x)):
                break
            step /= 2
            if step < 1e-14:
                return x, value
        s, y = nxt - x, slope - g
        if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
            pairs.append((s, y))
        x, value, g = nxt, new, slope
    return x, value
