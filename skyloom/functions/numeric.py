"""Small numeric functions for grouped Arrow work: FFT products, spectra, windows, fits, dense linear algebra."""

from __future__ import annotations

import numpy as np


def block_size(lam: int, n: int, rule: str = "band") -> int:
    """FFT length of overlap-save. ``band``: the next power of two of four bandwidths, unless the data are shorter; ``fixed``: 2^14 or, for wide
    bands, twice their width rounded up; ``cost``: the power of two with the least work a sample, n log n over the samples that one transform
    finishes."""
    least = 1 << max(2, (2 * lam - 1).bit_length())
    if rule == "fixed":
        return max(1 << 14, least)
    if rule == "cost":
        sizes = [least << k for k in range(8) if k == 0 or least << k - 1 < n]
        return min(sizes, key=lambda size: size * np.log2(size) * -(-n // (size - 2 * (lam - 1))))
    size = 1 << max(2, (4 * lam - 1).bit_length())
    return size if size <= n else 4 * lam


def product_method(lam: int, n: int, columns: int = 1) -> str:
    """Which product costs least: ``direct`` (n lam), ``fft`` (overlap-save) or ``full`` (one transform of the whole, for short data)."""
    size = block_size(lam, n, "cost")
    whole = 1 << max(2, (n + lam - 2).bit_length())
    # a direct term is one pass over the data; a transform's unit of work is about as dear as three of them, and its row is transformed too
    fft = lambda length, count: 3 * (count * columns * 2 + 1) * length * np.log2(length)
    costs = {"direct": 2 * columns * n * lam, "fft": fft(size, -(-n // max(1, size - 2 * (lam - 1)))), "full": fft(whole, 1)}
    return min(costs, key=costs.get)


def banded_product(t: np.ndarray, v: np.ndarray, method: str = "auto", size: int | str | None = None) -> np.ndarray:
    """Symmetric Toeplitz matrix with first row ``t`` (zero beyond) times v, along v's last axis. ``method``: direct, fft, full or auto;
    ``size``: of the transforms of fft, or the rule of ``block_size`` for it."""
    v = np.asarray(v, float)
    n, lam = v.shape[-1], min(len(t), v.shape[-1])
    if n == 0:
        return np.zeros(v.shape)
    t = np.asarray(t, float)[:lam]
    method = product_method(lam, n, v.size // n) if method == "auto" else method
    if method == "direct":
        return direct_product(t, v)
    if method == "full":
        size = 1 << max(2, (n + lam - 2).bit_length())
        return np.fft.irfft(np.fft.rfft(v, size) * np.fft.rfft(_column(t, size)), size)[..., :n]
    if method != "fft":
        raise ValueError(f"no product method {method}")
    size = size if isinstance(size, int) else block_size(lam, n + 2 * (lam - 1), size or "cost")
    if size < 2 * lam:
        raise ValueError(f"transforms of {size} are too short for a band of {lam}")
    step = size - 2 * (lam - 1)
    count = -(-n // step)
    padded = np.zeros((*v.shape[:-1], (count - 1) * step + size))
    padded[..., lam - 1 : lam - 1 + n] = v
    windows = np.lib.stride_tricks.sliding_window_view(padded, size, axis=-1)[..., ::step, :][..., :count, :]
    out = np.fft.irfft(np.fft.rfft(windows) * np.fft.rfft(_column(t, size)), size)
    return out[..., lam - 1 : lam - 1 + step].reshape(*v.shape[:-1], -1)[..., :n]


def _column(t: np.ndarray, size: int) -> np.ndarray:
    """First column of the circulant of that size which has the band."""
    column = np.zeros(size)
    column[: len(t)] = t
    column[size - len(t) + 1 :] = t[:0:-1]
    return column


def direct_product(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The same, term by term: for narrow bands."""
    v = np.asarray(v, float)
    out = t[0] * v if len(t) else np.zeros(v.shape)
    for k in range(1, min(len(t), v.shape[-1])):
        out[..., k:] += t[k] * v[..., :-k]
        out[..., :-k] += t[k] * v[..., k:]
    return out


def dense_toeplitz(t: np.ndarray, n: int) -> np.ndarray:
    gap = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    return np.where(gap < len(t), np.asarray(t, float)[np.minimum(gap, len(t) - 1)], 0.0)


#: The first numbers of the example rows; the rest is random, or 0 for the third.
EXAMPLE_ROWS = {1: (), 2: (10.0, 2.0, 3.0), 3: (2.0, -1.0, 0.0)}


def example_row(kind: int, size: int, seed: int | None = None) -> np.ndarray:
    """A first row to try products with: 0 uniform in 0..1, 1 in 1..2, 2 and 3 begin with fixed numbers."""
    rng = np.random.default_rng(size if seed is None else seed)
    row = rng.uniform(size=size) if kind != 3 else np.zeros(size)
    row = row + 1 if kind == 1 else row
    fixed = EXAMPLE_ROWS.get(kind, ())[:size]
    row[: len(fixed)] = fixed
    return row


def legendre(order: int, x: np.ndarray) -> np.ndarray:
    before, now = np.ones_like(x), x
    if order == 0:
        return before
    for n in range(2, order + 1):
        before, now = now, ((2 * n - 1) * x * now - (n - 1) * before) / n
    return now


def periodogram(v: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """One segment: linear trend removed, periodic Hann window, one-sided density."""
    n = len(v)
    t = np.arange(n)
    v = v - np.polyval(np.polyfit(t, v, 1), t) if n > 1 else v - v.mean()
    window = 0.5 - 0.5 * np.cos(2 * np.pi * t / n)
    power = np.abs(np.fft.rfft(v * window)) ** 2 / (rate * (window**2).sum())
    power[1 : -1 if n % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(n, 1 / rate), power


def psd(f: np.ndarray, log_sigma2: float, alpha: float, knee: float, fmin: float) -> np.ndarray:
    return 10.0**log_sigma2 * (1 + ((f + fmin) / knee) ** alpha)


def log_psd(f: np.ndarray, log_sigma2: float, alpha: float, knee: float, fmin: float) -> np.ndarray:
    return log_sigma2 + np.log10(1 + ((f + fmin) / knee) ** alpha)


def inverse_psd(f: np.ndarray, *p: float) -> np.ndarray:
    return 1 / psd(f, *p)


def log_inverse_psd(f: np.ndarray, *p: float) -> np.ndarray:
    return -log_psd(f, *p)


#: Fixed values of the noise model fit: start and bounds of (log10 sigma^2, alpha, knee, fmin).
FIT_START = (-7.0, -1.0, 0.1, 1e-6)
FIT_LOW = (-20.0, -10.0, 0.0, 0.0)
FIT_HIGH = (0.0, 0.0, 20.0, 1.0)


def fit_log_psd(f: np.ndarray, power: np.ndarray, most: int = 1000) -> np.ndarray:
    """Bounded damped least squares of log10(power) over positive frequencies."""
    ok = (f > 0) & (power > 0)
    return fit_means(f[ok], np.log10(power[ok]), np.ones(int(ok.sum())), most)


def fit_means(f: np.ndarray, y: np.ndarray, count: np.ndarray, most: int = 1000) -> np.ndarray:
    """The same for means y of log10(power) over ``count`` neighbouring frequencies each."""
    root = np.sqrt(count)
    low, high = np.array(FIT_LOW), np.array(FIT_HIGH)
    low[2] = 1e-8  # a knee of 0 has no value
    low[3] = 1e-12
    p, damping = np.clip(np.array(FIT_START), low, high), 1e-2
    misfit = lambda p: root * (log_psd(f, *p) - y)
    rest = misfit(p)
    cost = rest @ rest
    for _ in range(most):
        step = 1e-6 * np.maximum(np.abs(p), 1e-6)
        step = np.where(p + step > high, -step, step)
        jac = np.stack([(misfit(p + np.eye(4)[k] * step[k]) - rest) / step[k] for k in range(4)], 1)
        grad, hess = jac.T @ rest, jac.T @ jac
        free = ~(((p <= low) & (grad > 0)) | ((p >= high) & (grad < 0)))
        if not free.any() or np.abs(grad[free]).max() < 1e-12:
            break
        part = hess[np.ix_(free, free)]
        move = np.zeros(4)
        move[free] = np.linalg.lstsq(part + damping * np.diag(np.diag(part) + 1e-30), -grad[free], rcond=None)[0]
        new = np.clip(p + move, low, high)
        left = misfit(new)
        if left @ left < cost:
            gain = cost - left @ left
            p, rest, cost, damping = new, left, left @ left, max(damping / 5, 1e-12)
            if gain < 1e-12 * cost:
                break
        else:
            damping *= 5
            if damping > 1e12:
                break
    return p


def half_chebyshev(lam: int, decibel: float = 150.0) -> np.ndarray:
    """First half (from its centre) of the periodic Dolph-Chebyshev window of length 2 * lam."""
    m = 2 * lam + 1
    beta = np.cosh(np.arccosh(10 ** (decibel / 20)) / (m - 1))
    x = beta * np.cos(np.pi * np.arange(m) / m)
    poly = np.empty(m)
    inside = np.abs(x) <= 1
    poly[inside] = np.cos((m - 1) * np.arccos(x[inside]))
    poly[x > 1] = np.cosh((m - 1) * np.arccosh(x[x > 1]))
    poly[x < -1] = np.cosh((m - 1) * np.arccosh(-x[x < -1]))  # m - 1 is even
    window = np.real(np.fft.fft(poly))[: lam + 1]
    return (window / window[0])[:lam]


def half_gaussian(lam: int) -> np.ndarray:
    return np.exp(-0.5 * (np.arange(lam) / (lam / 3)) ** 2)


def inverse_noise_row(v: np.ndarray, rate: float, lam: int, window: str = "chebwin") -> tuple[np.ndarray, np.ndarray]:
    """First row (``lam`` values) of the inverse noise Toeplitz matrix of a sample vector, and the fitted parameters."""
    n = len(v)
    if lam > n // 2:
        raise ValueError(f"bandwidth {lam} is over half of the {n} samples")
    p = fit_log_psd(*periodogram(v, rate))
    f = np.fft.rfftfreq(n, 1 / rate)
    row = np.fft.irfft(inverse_psd(f, *p), n)[:lam]
    return row * (half_chebyshev(lam) if window == "chebwin" else half_gaussian(lam)), p


def chirp(k: np.ndarray, n: int) -> np.ndarray:
    """exp(i pi k^2 / n), its phase from exact integers."""
    k = np.asarray(k, np.int64)
    return np.exp(1j * np.pi * ((k * k) % (2 * n)) / n)


def partial_inverse(values: np.ndarray, first: int, n: int, lam: int) -> np.ndarray:
    """sum over k of values[k] exp(2 pi i (first + k) j / n) for j < lam: a stretch's part of an inverse transform of length n, by a chirp."""
    count = len(values)
    size = 1 << max(1, (count + lam - 1).bit_length())
    m, j = np.arange(count), np.arange(lam)
    kernel = np.zeros(size, complex)
    kernel[:lam] = np.conj(chirp(j, n))
    kernel[size - count + 1 :] = np.conj(chirp(np.arange(1, count)[::-1], n))
    out = np.fft.ifft(np.fft.fft(values * chirp(m, n), size) * np.fft.fft(kernel))[:lam] * chirp(j, n)
    return out * np.exp(2j * np.pi * (first * j % n) / n)


def effective_psd(t: np.ndarray, n: int) -> np.ndarray:
    """Spectrum of the circulant embedding of a truncated autocorrelation: its first n // 2 values."""
    column = np.zeros(n)
    column[: len(t)] = t
    column[n - len(t) + 1 :] = t[:0:-1]
    return np.abs(np.fft.rfft(column))[: n // 2]


def pseudo_inverse(k: np.ndarray, rcond: float = 1e-12) -> tuple[np.ndarray, int]:
    u, s, vt = np.linalg.svd(k, hermitian=True)
    ok = s > rcond * (s[0] if len(s) else 0)
    return (vt[ok].T / s[ok]) @ u[:, ok].T, int(ok.sum())
