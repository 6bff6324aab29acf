import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from skyloom.functions import numeric as N


@settings(max_examples=60, deadline=None)
@given(n=st.integers(1, 700), lam=st.integers(1, 200), seed=st.integers(0, 999))
def test_banded_product_is_dense(n, lam, seed):
    rng = np.random.default_rng(seed)
    t, v = rng.normal(size=lam), rng.normal(size=n)
    assert np.allclose(N.banded_product(t, v), N.dense_toeplitz(t, n) @ v, atol=1e-9)
    assert np.allclose(N.direct_product(t, v), N.dense_toeplitz(t, n) @ v, atol=1e-9)


@settings(max_examples=60, deadline=None)
@given(n=st.integers(1, 700), lam=st.integers(1, 200), m=st.integers(1, 4), seed=st.integers(0, 999))
def test_every_product_method_is_dense(n, lam, m, seed):
    """Of several columns at once, by each method and with transforms of each size."""
    rng = np.random.default_rng(seed)
    t, v = rng.normal(size=lam), rng.normal(size=(m, n))
    want = v @ N.dense_toeplitz(t, n)
    for method in ("auto", "direct", "full", "fft"):
        assert np.allclose(N.banded_product(t, v, method), want, atol=1e-9)
    for size in (N.block_size(lam, n), N.block_size(lam, n, "fixed"), N.block_size(lam, n, "cost"), 2 * lam + 1):
        if size >= 2 * lam:
            assert np.allclose(N.banded_product(t, v, "fft", size), want, atol=1e-9)


def test_the_cheapest_method():
    assert N.product_method(2, 100_000) == "direct" and N.product_method(2000, 1_000_000) == "fft" and N.product_method(3000, 4000) == "full"
    assert N.block_size(100, 1 << 20, "cost") >= 256 and N.block_size(100, 1 << 20, "fixed") == 1 << 14
    with pytest.raises(ValueError):
        N.banded_product(np.ones(40), np.ones(100), "fft", 64)
    with pytest.raises(ValueError):
        N.banded_product(np.ones(40), np.ones(100), "other")


def test_worked_rows():
    v = np.array([1.0, 2, 4, 8, 16])
    assert N.banded_product(np.array([2.0, -1, 0]), v).tolist() == [0, -1, -2, -4, 24]
    assert N.banded_product(np.array([10.0, 2, 3]), v).tolist() == [26, 54, 111, 126, 188]
    assert np.allclose(N.banded_product(np.array([2.0, -1, 0]), v - v.mean()), [-6.2, -1, -2, -4, 17.8])


def test_legendre_on_five_samples():
    x = np.linspace(-1, 1, 5)
    for k, want in enumerate(([1, 1, 1, 1, 1], [-1, -0.5, 0, 0.5, 1], [1, -0.125, -0.5, -0.125, 1], [-1, 0.4375, 0, -0.4375, 1])):
        assert np.allclose(N.legendre(k, x), want)


def test_periodogram_conserves_power():
    v = np.random.default_rng(1).normal(size=4096)
    f, p = N.periodogram(v, 10.0)
    assert abs(p.sum() * (f[1] - f[0]) - v.var()) < 0.1 * v.var()


def test_fit_follows_the_model():
    f = np.fft.rfftfreq(8192, 1 / 50)
    true = (-6.0, -1.7, 0.8, 1e-4)
    power = N.psd(f, *true) * np.random.default_rng(2).exponential(size=len(f))
    p = N.fit_log_psd(f, power)
    band = (f > 0.05) & (f < 20)
    bias = np.mean(np.log10(power[band]) - N.log_psd(f[band], *true))  # of the logarithm of the noise
    assert np.abs(N.log_psd(f[band], *p) - bias - N.log_psd(f[band], *true)).max() < 0.25
    assert np.all(p >= N.FIT_LOW) and np.all(p <= N.FIT_HIGH)
    assert np.allclose(N.log_inverse_psd(f[1:], *p), np.log10(N.inverse_psd(f[1:], *p)))


@pytest.mark.parametrize("lam", [1, 2, 16, 512])
def test_half_windows(lam):
    c, g = N.half_chebyshev(lam), N.half_gaussian(lam)
    assert len(c) == len(g) == lam and np.isclose(c[0], 1) and np.isclose(g[0], 1)
    assert np.all(np.diff(c) < 0) and np.all(c > -1e-8)
    if lam == 16:
        full = np.concatenate([c[:0:-1], c])
        spectrum = np.abs(np.fft.fft(np.concatenate([full, np.zeros(4096)])))
        assert spectrum[len(spectrum) // 2] < 1e-5 * spectrum[0]


def test_inverse_noise_of_white_noise_is_a_spike():
    v = 1e-3 * np.random.default_rng(3).normal(size=4096)
    row, _ = N.inverse_noise_row(v, 1.0, 64)
    assert row[0] > 0 and np.abs(row[1:]).max() < 0.3 * row[0]
    with pytest.raises(ValueError):
        N.inverse_noise_row(v, 1.0, 2049)


def test_effective_psd_is_the_transform_of_the_row():
    t = np.array([10.0, 2, 3])
    f = np.arange(8) / 16  # n // 2 values, without the highest frequency
    assert np.allclose(N.effective_psd(t, 16), np.abs(10 + 4 * np.cos(2 * np.pi * f) + 6 * np.cos(4 * np.pi * f)))


def test_pseudo_inverse():
    x = np.random.default_rng(4).normal(size=(6, 4))
    k = x @ x.T
    inv, rank = N.pseudo_inverse(k)
    assert rank == 4 and np.allclose(inv, np.linalg.pinv(k, rcond=1e-12))
