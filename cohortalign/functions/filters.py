"""Butterworth high-pass filtering with NumPy, along the first axis, many channels at once."""

from __future__ import annotations

import numpy as np

STEPS = 32  # steps that are filtered at once
_made: dict[tuple, list] = {}


def butter_sections(order: int, cutoff: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Coefficients (b, a) of sections of first and second order, to be applied one after another, for a cutoff
    given as a share of the Nyquist frequency; by the bilinear transform of the analogue prototype. Sections round far
    less than the product of them all."""
    k = np.arange(1, order + 1)
    proto = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    poles = 4 * np.tan(np.pi * cutoff / 2) / proto
    z = (4 + poles) / (4 - poles)
    alone, upper = z[np.abs(z.imag) < 1e-9].real, z[z.imag >= 1e-9]
    out = [(np.poly([1.0]), np.array([1.0, -p])) for p in alone] + [(np.poly([1.0, 1.0]), np.array([1.0, -2 * p.real, abs(p) ** 2])) for p in upper]
    gain = np.real(np.prod(4.0 / (4 - poles)))
    return [(b * gain if i == 0 else b, a) for i, (b, a) in enumerate(out)]


def butter_highpass(order: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """The sections multiplied out: (b, a)."""
    b, a = np.ones(1), np.ones(1)
    for more, under in butter_sections(order, cutoff):
        b, a = np.convolve(b, more), np.convolve(a, under)
    return b, a


def _block_form(b: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, ...]:
    """A filter over ``STEPS`` steps as matrices: output = inner x + outer s, next state = power s + gather x;
    and the state for a constant input of one."""
    n = len(a) - 1
    move = np.zeros((n, n))
    move[:, 0] = -a[1:]
    move[:-1, 1:] = np.eye(n - 1)
    enter = b[1:] - a[1:] * b[0]
    powers = [np.eye(n)]
    for _ in range(STEPS):
        powers.append(move @ powers[-1])
    reach = np.array([p @ enter for p in powers[:STEPS]])  # state after an impulse
    lag = np.subtract.outer(np.arange(STEPS), np.arange(STEPS))
    inner = np.where(lag > 0, reach[np.maximum(lag - 1, 0), 0], np.where(lag == 0, b[0], 0.0))
    outer = np.array([p[0] for p in powers[:STEPS]])
    return inner, outer, powers[STEPS], reach[::-1].T.copy(), np.linalg.solve(np.eye(n) - move, enter)


def _forms(order: int, cutoff: float) -> list[tuple[np.ndarray, ...]]:
    if (order, cutoff) not in _made:
        _made[order, cutoff] = [_block_form(b, a) for b, a in butter_sections(order, cutoff)]
    return _made[order, cutoff]


def _run(forms: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    """One pass over x, started as if its first value had always been there: the first section lets nothing
    of a constant through, so that the others start at rest."""
    for i, (inner, outer, power, gather, steady) in enumerate(forms):
        y, s = np.empty_like(x), np.outer(steady, x[0] if i == 0 else np.zeros(x.shape[1]))
        for at in range(0, len(x), STEPS):
            part = x[at:at + STEPS]
            k = len(part)
            y[at:at + k] = inner[:k, :k] @ part + outer[:k] @ s
            if k == STEPS:
                s = power @ s + gather @ part
        x = y
    return x


def highpass(x: np.ndarray, cutoff_hz: float, step: float, order: int = 5) -> np.ndarray:
    """Forward and backward filtering of (T, channels), padded by odd extension of 3 x (order + 1)
    steps. A cutoff at or above Nyquist leaves the data as they are."""
    nyquist = 0.5 / step
    pad = 3 * (order + 1)
    if cutoff_hz >= nyquist:
        return x
    if len(x) <= pad:
        raise ValueError("series too short to filter")
    forms = _forms(order, cutoff_hz / nyquist)
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2:-pad - 2:-1]]).astype(float)
    for _ in range(2):
        wide = _run(forms, wide)[::-1]
    return wide[pad:-pad]


def detrend(x: np.ndarray) -> np.ndarray:
    """Residual of the least-squares line of each column."""
    t = np.arange(len(x)) - (len(x) - 1) / 2
    m = x - x.mean(0)
    return m - np.outer(t, t @ m / max(t @ t, 1e-300))


def regress_out(x: np.ndarray, confounds: np.ndarray) -> np.ndarray:
    """Residual of minimum-norm least squares on the confounds and an intercept."""
    if not confounds.shape[1]:
        return x
    design = np.column_stack([np.ones(len(x)), confounds])
    return x - design @ np.linalg.lstsq(design, x, rcond=None)[0]


def zscore(x: np.ndarray, floor: float = 1e-8) -> np.ndarray:
    return (x - x.mean(0)) / np.maximum(x.std(0), floor)
