import math

import numpy as np
import pytest

from kinelake.functions import dsp


def response(sos, w):
    z = np.exp(-1j * np.pi * w)
    return np.prod([(s[0] + s[1] * z + s[2] * z**2) / (s[3] + s[4] * z + s[5] * z**2) for s in sos])


def test_known_sections():
    s = dsp.butterworth(2, 0.5, "low")[0]
    assert np.allclose(s, [0.29289322, 0.58578644, 0.29289322, 1, 0, 0.17157288])
    s = dsp.butterworth(1, 0.25, "high")[0]
    assert np.allclose(s, [0.70710678, -0.70710678, 0, 1, -0.41421356, 0])


@pytest.mark.parametrize("order", [1, 2, 3, 4, 6])
def test_half_power_at_cutoff(order):
    for kind, cut, through, stop in (("low", 0.2, 1e-6, 0.9), ("high", 0.2, 1 - 1e-6, 0.02), ("band", (0.1, 0.4), 0.2, 0.95)):
        sos = dsp.butterworth(order, cut, kind)
        for c in np.atleast_1d(cut):
            assert math.isclose(abs(response(sos, c)), math.sqrt(0.5), rel_tol=1e-6)
        assert abs(response(sos, stop)) < 0.6
        if kind != "band":
            assert math.isclose(abs(response(sos, through)), 1, rel_tol=1e-4)
    c = dsp.chebyshev_low(8, 0.05, 0.3)
    assert math.isclose(abs(response(c, 0.3)), 10 ** (-0.05 / 20), rel_tol=1e-6) and abs(response(c, 0.6)) < 1e-3


def test_recursion_is_the_difference_equation():
    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    b, a = np.array([0.2, 0.3, 0.1]), np.array([1, -0.5, 0.25])
    y = np.zeros(500)
    for n in range(500):
        y[n] = sum(b[k] * x[n - k] for k in range(3) if n >= k) - sum(a[k] * y[n - k] for k in (1, 2) if n >= k)
    assert np.allclose(dsp.Recursion.transfer(b, a)(x), y)
    assert np.allclose(dsp.Recursion.sections(np.array([[*b, *a]]))(x), y)
    f = dsp.Recursion.sections(dsp.butterworth(4, 0.2, "low"))
    assert np.allclose(f(np.ones(300), f.steady()), 1)


def test_zero_phase_keeps_phase():
    t = np.arange(0, 10, 0.02)
    slow, fast = np.sin(2 * np.pi * 0.5 * t), np.sin(2 * np.pi * 15 * t)
    y = dsp.zero_phase(dsp.butterworth(4, 3 / 25, "low"), slow + fast)
    assert np.abs(y - slow)[50:-50].max() < 0.01
    with pytest.raises(ValueError):
        dsp.zero_phase(dsp.butterworth(4, 0.1, "low"), np.ones(5))


def test_peaks():
    x = np.array([0, 1, 0, 2, 2, 2, 0, 3, 1, 2.5, 0])
    assert dsp.find_peaks(x).tolist() == [1, 4, 7, 9]
    assert dsp.find_peaks(x, height=2).tolist() == [4, 7, 9]
    assert dsp.find_peaks(x, distance=3).tolist() == [1, 4, 7]
    assert dsp.find_peaks(x, prominence=1.9).tolist() == [4, 7]


def test_spectra():
    fs, t = 50.0, np.arange(256) / 50
    x = np.sin(2 * np.pi * 3 * t)[None, :]
    assert abs(dsp.dominant_frequency(x, fs)[0] - 3) < 0.05
    assert dsp.power_spectral_sum(x, fs)[0] > 0.9 and dsp.spectral_entropy(x, fs)[0] < dsp.spectral_entropy(np.random.default_rng(1).normal(size=(1, 256)), fs)[0]
    assert dsp.range_power_sum(x, fs, low=2, high=4, normalize=True)[0] > 0.95
    assert dsp.spectral_flatness(x, fs)[0] < -10 and dsp.sparc(x, fs)[0] < 0


def test_sample_entropy_by_templates():
    rng = np.random.default_rng(4)
    x, m, r = rng.normal(size=60), 3, 0.8
    match = lambda k, stop: sum(all(abs(x[i + q] - x[j + q]) < r for q in range(k)) for i in range(stop) for j in range(i + 1, stop))
    a, b = match(m, len(x) - m + 1), match(m - 1, len(x) - m + 1)
    assert math.isclose(dsp.sample_entropy(x, m, r), -math.log(a / b))


@pytest.mark.parametrize("moments", [1, 2, 4])
def test_wavelets_rebuild(moments):
    taps = dsp.daubechies(moments)
    if moments == 2:
        assert np.allclose(taps, [0.48296291, 0.83651630, 0.22414387, -0.12940952], atol=1e-7)
    x = np.random.default_rng(2).normal(size=96)
    a, d = dsp.wavelet_levels(x, taps, 3)
    assert np.allclose(dsp.from_levels(a, d, taps)[:96], x, atol=1e-8)


def test_sphere():
    rng = np.random.default_rng(7)
    truth = rng.normal(size=(400, 3))
    truth /= np.linalg.norm(truth, axis=1, keepdims=True)
    scale, offset = np.array([1.07, 1.05, 0.991]), np.array([0.02, -0.03, 0.01])
    raw = truth / scale - offset
    got_offset, got_scale, _, done = dsp.fit_sphere(raw, rng.normal(25, 2, 400))
    assert done and np.allclose(got_scale, scale, rtol=1e-3) and np.allclose(got_offset, offset, atol=1e-3)
    assert not dsp.fit_sphere(np.abs(raw), np.zeros(400))[3]


def test_coiflet_taps():
    h = dsp.wavelet("coif4")
    assert np.isclose(h.sum(), np.sqrt(2)) and all(abs(h[2 * k :] @ h[: len(h) - 2 * k] - (k == 0)) < 1e-9 for k in range(12))
    n = np.arange(24) / 10
    assert all(abs((h * (-1.0) ** np.arange(24)) @ n**p) < 1e-9 for p in range(8))  # vanishing moments of the wavelet
    assert all(abs(h @ (n - 0.8) ** p) < 1e-9 for p in range(1, 8))  # and of the scaling function
    x = np.random.default_rng(0).normal(size=100)
    assert np.allclose(dsp.from_levels(*dsp.wavelet_levels(x, h, 3), h)[: len(x)], x)
    assert np.array_equal(dsp.wavelet("db4"), dsp.daubechies(4))
    with pytest.raises(ValueError):
        dsp.wavelet("db0")
