"""Array forms of the stateful operators: a run of ordered rows and the state before it give the rows' results and the state after. Batch and streaming share them."""

from __future__ import annotations

import numpy as np


def finite(x: np.ndarray) -> np.ndarray:
    """Values that aren't finite (null comes as NaN) are 0."""
    return np.where(np.isfinite(x), x, 0.0)


def prefix_scan(maps: tuple[np.ndarray, ...], compose) -> tuple[np.ndarray, ...]:
    """Row i: the composition of maps 0 to i, by doubling. compose(earlier, later) works on arrays."""
    maps, step = tuple(m.copy() for m in maps), 1
    while step < len(maps[0]):
        made = compose(tuple(m[:-step] for m in maps), tuple(m[step:] for m in maps))
        for m, x in zip(maps, made, strict=True):
            m[step:] = x
        step *= 2
    return maps


def _affine(a, b):
    return a[0] * b[0], b[0] * a[1] + b[1]


def _choice(a, b):
    return np.where(a[0], b[1], b[0]), np.where(a[1], b[1], b[0])


def ema_run(x: np.ndarray, new: np.ndarray, alpha: float, before: float) -> np.ndarray:
    """alpha * x + (1 - alpha) * the last, row by row; `new` rows start from 0, the first row from `before`. Each row is the affine map of its state, and the maps are composed."""
    if not len(x):
        return x
    slope, shift = prefix_scan((np.where(new, 0.0, 1 - alpha), alpha * finite(x)), _affine)
    return slope * before + shift


def switch_run(x: np.ndarray, new: np.ndarray, on: float, off: float, before: bool) -> np.ndarray:
    """True at `off` or more after a true row, at `on` or more else; `new` rows follow a false one. Each row is a map of two states."""
    if not len(x):
        return np.zeros(0, bool)
    up, stay = x >= on, x >= off
    after_false, after_true = prefix_scan((up, np.where(new, up, stay)), _choice)
    return after_true if before else after_false


def ema_switch_run(x: np.ndarray, new: np.ndarray, alpha: float, on: float, off: float, ema: float, active: bool) -> tuple[np.ndarray, np.ndarray]:
    e = ema_run(x, new, alpha, ema)
    return e, switch_run(e, new, on, off, active)


def hysteresis_run(x: np.ndarray, on: float, off: float, min_on: int, hold: int, active: bool, below: int) -> tuple[np.ndarray, int, bool, int]:
    """Active rows, how many rows at the end may still be filled, and the state (active, rows under `off`) after the settled ones. The run begins where no row is open."""
    x = finite(x)
    at = np.arange(1, len(x) + 1)
    above_run = at - np.maximum.accumulate(np.where(x < on, at, 0)) if len(x) else at
    last = np.maximum.accumulate(np.where(x >= off, at, 0)) if len(x) else at
    below_run = np.where(last > 0, at - last, at + below)
    event = np.where(above_run >= min_on, 1, np.where(below_run > hold, 0, -1))
    said = np.maximum.accumulate(np.where(event >= 0, at, 0)) if len(x) else at
    state = np.where(said > 0, event[np.maximum(said - 1, 0)] == 1, active) if len(x) else np.zeros(0, bool)
    begins = state & ~np.concatenate([[active], state[:-1]]) if len(x) else state
    filled = state.copy()
    for back in range(1, min_on):
        filled[:-back] |= begins[back:]
    open_ = int(above_run[-1]) if len(x) and not state[-1] else 0
    end = len(x) - open_
    return filled, open_, bool(state[end - 1]) if end else active, int(below_run[end - 1]) if end else below


def rate_run(x: np.ndarray, limit: float, low: float, high: float, last: float | None) -> tuple[list[float | None], float | None]:
    """Each row moves at most `limit` from the last output, within [low, high]; the first finite value stands as it is, and a value that isn't finite keeps the last output within the bounds."""
    out: list[float | None] = []
    for v, known in zip(x.tolist(), np.isfinite(x).tolist(), strict=True):
        if last is None:
            last = v if known else None
        else:
            v = v if known else last
            v = last - limit if v < last - limit else last + limit if v > last + limit else v
            last = low if v < low else high if v > high else v
        out.append(last)
    return out, last
