"""Kalman filters over many series at once (numpy, one lane per series)."""

from __future__ import annotations

import numpy as np


#: What :func:`trend_moments` adds up.
MOMENTS = ("n", "aa", "ab", "bb", "ae", "be", "dt", "steps")


def trend_moments(t: np.ndarray, y: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Sums from which :func:`trend_noise` gets the noise of a series; those of its parts add up.

    The error of a reading against the line through its neighbours has variance r (1 + w^2 + (1-w)^2) from the
    readings and q d1 d2 / (d1 + d2) from the level's walk. Squared errors far beyond the part's median count as that many
    medians. Only readings in ``own`` are counted, their neighbours need not be.
    """
    d = np.diff(t)
    d1, d2 = d[:-1], d[1:]
    use = (d1 > 0) & (d2 > 0) & own[1:-1]
    steps = d[(d > 0) & own[1:]]
    d1, d2 = d1[use], d2[use]
    w = d2 / (d1 + d2)
    e = y[1:-1][use] - (w * y[:-2][use] + (1 - w) * y[2:][use])
    a = 1 + w**2 + (1 - w) ** 2
    b = d1 * d2 / (d1 + d2)
    e2 = e**2
    if len(e2) >= 6:
        e2 = np.minimum(e2, 25 * max(np.median(e2), 1e-12))
    return np.array([len(e2), a @ a, a @ b, b @ b, a @ e2, b @ e2, steps.sum(), len(steps)], dtype=float)


def trend_noise(moments: np.ndarray, fallback: float) -> tuple[float, float]:
    """Observation variance and level variance per second of one series, least squares over its moments.

    ``fallback``: variance of the series, from which both are taken when there are few readings.
    """
    n, aa, ab, bb, ae, be, dt, steps = np.nan_to_num(moments)
    fallback = fallback if np.isfinite(fallback) and fallback > 0 else 1.0
    if n < 6:
        return 0.1 * fallback, 0.1 * fallback / (dt / steps if steps else 3600.0)
    both = ae / aa, be / bb
    det = aa * bb - ab**2
    r, q = ((bb * ae - ab * be) / det, (aa * be - ab * ae) / det) if det > 1e-9 * aa * bb else (both[0] / 2, both[1] / 2)
    if r <= 0:
        r, q = 0.02 * both[0], both[1]
    if q <= 0:
        r, q = both[0], 0.02 * both[1]
    return max(r, 1e-9), max(q, 1e-15)


def smooth_local_trend(
    t: np.ndarray, y: np.ndarray, r: np.ndarray, q: np.ndarray, damping: float = 1e-3, typical: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Level and its variance at all times, by a Kalman filter and a Rauch-Tung-Striebel pass.

    ``t``, ``y``: (steps, lanes), times in seconds that do not fall, values with NaN where there is no reading.
    ``r``, ``q``: per lane, the variance of a reading and of the level's walk per second. The slope walks with
    ``damping`` times what would carry the level's own walk over the ``typical`` step (the lane's median if not given). Lanes without a reading give NaN.
    """
    steps, lanes = t.shape
    dt = np.diff(t, axis=0, prepend=t[:1])
    if typical is None:
        typical = np.array([np.median(c[c > 0]) if (c > 0).any() else 1.0 for c in dt.T])
    qs = damping * q / typical**2
    seen = ~np.isnan(y)
    first = np.where(seen.any(0), seen.argmax(0), 0)
    start = np.nan_to_num(y[first, np.arange(lanes)])
    spread = np.nan_to_num(np.nanvar(np.where(seen.any(0), y, 0), axis=0)) + r
    level, slope = start.copy(), np.zeros(lanes)
    a, b, c = 10 * spread + 1e-9, np.zeros(lanes), q / typical  # covariance [[a, b], [b, c]]
    mp, pp, mf, pf = (np.empty((steps, k, lanes)) for k in (2, 3, 2, 3))
    for i in range(steps):
        h = dt[i]
        level = level + h * slope
        a = a + h * (2 * b + h * c) + q * h + qs * h**3 / 3
        b = b + h * c + qs * h**2 / 2
        c = c + qs * h
        mp[i, 0], mp[i, 1], pp[i, 0], pp[i, 1], pp[i, 2] = level, slope, a, b, c
        s = seen[i]
        if s.any():
            k = np.where(s, 1.0 / (a + r), 0.0)
            ka, kb = a * k, b * k
            e = np.where(s, y[i] - level, 0.0)
            level, slope = level + ka * e, slope + kb * e
            a, b, c = a - ka * a, b - ka * b, c - kb * b
        mf[i, 0], mf[i, 1], pf[i, 0], pf[i, 1], pf[i, 2] = level, slope, a, b, c
    out, var = np.empty((steps, lanes)), np.empty((steps, lanes))
    ls, ss, a, b, c = mf[-1, 0], mf[-1, 1], pf[-1, 0], pf[-1, 1], pf[-1, 2]
    out[-1], var[-1] = ls, a
    for i in range(steps - 2, -1, -1):
        h = dt[i + 1]
        fa, fb, fc = pf[i]
        pa, pb, pc = pp[i + 1]
        det = np.maximum(pa * pc - pb * pb, 1e-300)
        x1, x2 = fa + h * fb, fb  # rows of P F'
        y1, y2 = fb + h * fc, fc
        g11, g12 = (x1 * pc - x2 * pb) / det, (x2 * pa - x1 * pb) / det
        g21, g22 = (y1 * pc - y2 * pb) / det, (y2 * pa - y1 * pb) / det
        dl, ds = ls - mp[i + 1, 0], ss - mp[i + 1, 1]
        ls, ss = mf[i, 0] + g11 * dl + g12 * ds, mf[i, 1] + g21 * dl + g22 * ds
        da, db, dc = a - pa, b - pb, c - pc
        a, b, c = (
            fa + g11 * g11 * da + 2 * g11 * g12 * db + g12 * g12 * dc,
            fb + g11 * g21 * da + (g11 * g22 + g12 * g21) * db + g12 * g22 * dc,
            fc + g21 * g21 * da + 2 * g21 * g22 * db + g22 * g22 * dc,
        )
        out[i], var[i] = ls, np.maximum(a, 0)
    none = ~seen.any(0)
    out[:, none] = np.nan
    var[:, none] = np.nan
    return out, var


def local_level_innovations(y: np.ndarray, r: np.ndarray, q: np.ndarray, gate: float, patience: int = 4) -> np.ndarray:
    """Standardised innovations of a local-level filter; updates beyond ``gate`` are withheld.

    ``y``: (steps, lanes) with NaN at the end of shorter lanes. After ``patience`` readings withheld in a row the
    level is taken to have moved and the filter starts again from the present reading.
    """
    steps, lanes = y.shape
    z = np.full((steps, lanes), np.nan)
    level = y[0].copy()
    p = r * 1.0
    held = np.zeros(lanes, dtype=np.int64)
    for i in range(steps):
        p = p + q
        e = y[i] - level
        s = p + r
        zi = e / np.sqrt(s)
        z[i] = zi
        ok = np.abs(zi) <= gate
        moved = ~ok & (held >= patience)
        k = np.where(ok, p / s, 0.0)
        level = np.where(moved, y[i], np.where(ok, level + k * e, level))
        p = np.where(moved, r, p * (1 - k))
        held = np.where(ok | moved, 0, held + 1)
    return z
