"""Signal processing in numpy: filters, peaks, spectra, entropies, wavelets."""

from __future__ import annotations

import math

import numpy as np

# -- recursive filters ------------------------------------------------------


def butterworth(order: int, cutoff: float | tuple[float, float], kind: str) -> np.ndarray:
    """Second-order sections; cutoff as a share of half the sampling rate; kind low, high or band."""
    k = np.arange(1, order + 1)
    poles = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    warp = 4 * np.tan(np.pi * np.atleast_1d(np.asarray(cutoff, float)) / 2)
    if kind == "low":
        p, zeros, gain = warp[0] * poles, np.zeros(0), warp[0] ** order
    elif kind == "high":
        p, zeros, gain = warp[0] / poles, np.zeros(order), 1.0
    elif kind == "band":
        width, centre = warp[1] - warp[0], warp[0] * warp[1]
        half = poles * width / 2
        root = np.sqrt(half**2 - centre)
        p, zeros, gain = np.concatenate([half + root, half - root]), np.zeros(order), width**order
    else:
        raise ValueError(f"unknown kind of filter: {kind}")
    return _sections(p, zeros, gain)


def chebyshev_low(order: int, ripple: float, cutoff: float) -> np.ndarray:
    """Low-pass sections of a Chebyshev filter with `ripple` dB in the pass band."""
    e = math.sqrt(10 ** (ripple / 10) - 1)
    mu = math.asinh(1 / e) / order
    theta = np.pi * (2 * np.arange(1, order + 1) - 1) / (2 * order)
    poles = -np.sinh(mu) * np.sin(theta) + 1j * np.cosh(mu) * np.cos(theta)
    gain = float(np.real(np.prod(-poles))) / (math.sqrt(1 + e * e) if order % 2 == 0 else 1.0)
    w = 4 * np.tan(np.pi * cutoff / 2)
    return _sections(w * poles, np.zeros(0), gain * w**order)


def _sections(p: np.ndarray, zeros: np.ndarray, gain: float) -> np.ndarray:
    """Bilinear transform of analogue poles and (real) zeros, in sections with poles paired by conjugation."""
    pz, zz = (4 + p) / (4 - p), (4 + zeros) / (4 - zeros)
    gain = gain * float(np.real(np.prod(4 - zeros) / np.prod(4 - p)))
    zz = np.concatenate([zz, -np.ones(len(p) - len(zeros))])
    upper = sorted(pz[np.imag(pz) > 1e-12], key=abs)
    real = sorted(np.real(pz[np.abs(np.imag(pz)) <= 1e-12]), key=abs)
    pairs = [(2 * q.real, -abs(q) ** 2) for q in upper]
    while len(real) > 1:
        a, b = real.pop(), real.pop()
        pairs.append((a + b, -a * b))
    zz = sorted(np.real(zz))
    out = []
    for a1, a2 in pairs:
        # a zero from either end, so that each section of a band-pass has one of both
        z1, z2 = zz.pop(0), zz.pop()
        out.append([1.0, -(z1 + z2), z1 * z2, 1.0, -a1, -a2])
    if real:
        out.append([1.0, -zz.pop(), 0.0, 1.0, -real[0], 0.0])
    out.sort(key=lambda s: abs(s[5]) or abs(s[4]))
    out = np.array(out)
    out[0, :3] *= gain
    return out


class Recursion:
    """A recursive filter in state space, run over blocks by matrix products."""

    BLOCK = 64

    def __init__(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: float):
        self.a, self.b, self.c, self.d = a, b, c, d
        n, size = len(a), self.BLOCK
        power = [np.eye(n)]
        for _ in range(size):
            power.append(a @ power[-1])
        self.seen = np.stack([c @ p for p in power[:size]])
        response = np.array([d, *[c @ p @ b for p in power[: size - 1]]])
        lag = np.arange(size)[:, None] - np.arange(size)[None, :]
        self.inner = np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)
        self.reach = np.stack([power[size - 1 - k] @ b for k in range(size)], axis=1)
        self.jump = power[size]

    @classmethod
    def sections(cls, sos: np.ndarray) -> Recursion:
        """Sections in series, each in transposed direct form."""
        n = 2 * len(sos)
        a, b, c, d = np.zeros((n, n)), np.zeros(n), np.zeros(n), 1.0
        row, gain = np.zeros(n), 1.0  # the input of the next section, in states and input
        for k, (b0, b1, b2, _, a1, a2) in enumerate(sos):
            i = 2 * k
            out, through = b0 * row, b0 * gain
            out = out.copy()
            out[i] += 1
            a[i], b[i] = b1 * row - a1 * out, b1 * gain - a1 * through
            a[i, i + 1] += 1
            a[i + 1], b[i + 1] = b2 * row - a2 * out, b2 * gain - a2 * through
            row, gain = out, through
        return cls(a, b, row, gain)

    @classmethod
    def transfer(cls, b: np.ndarray, a: np.ndarray) -> Recursion:
        n = len(a) - 1
        m = np.zeros((n, n))
        m[:, 0] = -a[1:]
        m[:-1, 1:] += np.eye(n - 1)
        c = np.zeros(n)
        c[0] = 1
        return cls(m, b[1:] - a[1:] * b[0], c, b[0])

    def steady(self) -> np.ndarray:
        """The state that a constant input of 1 leads to."""
        return np.linalg.solve(np.eye(len(self.a)) - self.a, self.b)

    def __call__(self, x: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
        size = self.BLOCK
        s = np.zeros(len(self.a)) if state is None else state
        u = np.concatenate([x, np.zeros(-len(x) % size)]).reshape(-1, size)
        pushed, states = u @ self.reach.T, np.empty((len(u), len(s)))
        for k in range(len(u)):
            states[k] = s
            s = self.jump @ s + pushed[k]
        return (u @ self.inner.T + states @ self.seen.T).ravel()[: len(x)]


def zero_phase(sos: np.ndarray, x: np.ndarray, pad: int | None = None) -> np.ndarray:
    """Filtered forwards and backwards; ends extended by point reflection."""
    if pad is None:
        taps = 2 * len(sos) + 1 - min(int((sos[:, 2] == 0).sum()), int((sos[:, 5] == 0).sum()))
        pad = 3 * taps
    if len(x) <= pad:
        raise ValueError(f"a signal of {len(x)} samples is too short for this filter ({pad})")
    f = Recursion.sections(sos)
    if pad:
        x = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    y = f(x, f.steady() * x[0])[::-1]
    y = f(y, f.steady() * y[0])[::-1]
    return y[pad : len(y) - pad] if pad else y


# -- peaks ------------------------------------------------------------------


def find_peaks(x: np.ndarray, height: float | None = None, distance: float | None = None, prominence: float | None = None) -> np.ndarray:
    """Strict local maxima (middles of plateaus), filtered by height, distance and prominence in this order."""
    if len(x) < 3:
        return np.zeros(0, np.int64)
    change = np.flatnonzero(np.diff(x) != 0)
    first, last = np.concatenate([[0], change + 1]), np.concatenate([change, [len(x) - 1]])
    level = x[first]
    top = np.zeros(len(first), bool)
    top[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    peaks = (first[top] + last[top]) // 2
    if height is not None:
        peaks = peaks[x[peaks] >= height]
    if distance is not None and len(peaks):
        keep, near = np.ones(len(peaks), bool), math.ceil(distance)
        for i in np.argsort(x[peaks], kind="stable")[::-1].tolist():
            if keep[i]:
                close = np.abs(peaks - peaks[i]) < near
                close[i] = False
                keep &= ~close
        peaks = peaks[keep]
    if prominence is not None and len(peaks):
        peaks = peaks[[_prominence(x, p) >= prominence for p in peaks]]
    return peaks


def _prominence(x: np.ndarray, peak: int) -> float:
    higher = np.flatnonzero(x > x[peak])
    left = higher[higher < peak]
    right = higher[higher > peak]
    a, b = (left[-1] if len(left) else 0), (right[0] if len(right) else len(x) - 1)
    return float(x[peak] - max(x[a : peak + 1].min(), x[peak : b + 1].min()))


# -- spectra (rows are windows) ---------------------------------------------


def _band(fs: float, half: int, low: float, high: float) -> tuple[int, int]:
    """First and one past the last bin; limits count half - 1 steps to the highest frequency."""
    hi = min(math.floor(high / (fs / 2) * (half - 1) + 1), half)
    return max(math.ceil(low / (fs / 2) * (half - 1) + 1), 1) - 1, hi


def _power(x: np.ndarray, padlevel: int) -> tuple[np.ndarray, int]:
    half = 2 ** (math.ceil(math.log2(x.shape[1])) - 1 + padlevel)
    return np.abs(np.fft.rfft(x, 2 * half, axis=1)) ** 2, half


def _shares(x, fs, padlevel, low, high):
    p, half = _power(x, padlevel)
    a, b = _band(fs, half, low, high)
    total = p[:, a:b].sum(axis=1, keepdims=True)
    return p / np.where(total > 0, total, 1) + 1e-10, half, a, b


def dominant_frequency(x, fs, padlevel=2, low=0.0, high=5.0):
    p, half, a, b = _shares(x, fs, padlevel, low, high)
    return (p[:, a:b].argmax(axis=1) + a) * fs / half / 2


def dominant_frequency_value(x, fs, padlevel=2, low=0.0, high=5.0):
    p, _, a, b = _shares(x, fs, padlevel, low, high)
    return p[:, a:b].max(axis=1)


def power_spectral_sum(x, fs, padlevel=2, low=0.0, high=5.0):
    """Power within half a hertz of the peak."""
    p, half, a, b = _shares(x, fs, padlevel, low, high)
    peak = p[:, a:b].argmax(axis=1) + a
    width = 0.5 * half / fs * 2
    lo, hi = np.maximum(peak - math.ceil(width), 0), np.minimum(peak + math.floor(width), half - 1)
    total = np.concatenate([np.zeros((len(p), 1)), np.cumsum(p, axis=1)], axis=1)
    rows = np.arange(len(p))
    return total[rows, hi + 1] - total[rows, lo]


def range_power_sum(x, fs, padlevel=0, low=0.0, high=5.0, demean=False, use_modulus=False, normalize=False):
    p, half = _power(x, padlevel)
    p = np.sqrt(p) if use_modulus else p
    a, b = _band(fs, half, low, high)
    band = p[:, a:b].sum(axis=1)
    return band / p[:, int(demean) : half].sum(axis=1) if normalize else band


def spectral_flatness(x, fs, padlevel=2, low=0.0, high=5.0):
    p, _, a, b = _shares(x, fs, padlevel, low, high)
    return 10 * np.log10(np.exp(np.log(p[:, a:b]).mean(axis=1)) / p[:, a:b].mean(axis=1))


def spectral_entropy(x, fs, padlevel=2, low=0.0, high=5.0):
    p, _, a, b = _shares(x, fs, padlevel, low, high)
    return -(p[:, a:b] * np.log2(p[:, a:b])).sum(axis=1) / math.log2(b - a)


def sparc(x, fs, padlevel=4, cutoff=10.0, amplitude=0.05):
    """Spectral arc length: of the magnitude over its largest, up to the cutoff, trimmed where it is small."""
    size = 2 ** (math.ceil(math.log2(x.shape[1])) + padlevel)
    m = np.abs(np.fft.rfft(x, size, axis=1))
    m = m / m.max(axis=1, keepdims=True)
    stop = min(math.ceil(cutoff / (0.5 * fs) * (size // 2)), size // 2 + 1)
    out = np.zeros(len(x))
    for r, row in enumerate(m):
        large = np.flatnonzero(row >= amplitude)
        first = large[0] if len(large) else len(row) - 1
        below = large[large < stop]
        last = below[-1] if len(below) else 0
        if last > first:
            out[r] = -np.sqrt(1 / (last - first) ** 2 + np.diff(row[first : last + 1]) ** 2).sum()
    return out


# -- entropies --------------------------------------------------------------


def sample_entropy(x: np.ndarray, m: int = 4, r: float = 1.0) -> float:
    """-log of matches of m samples by matches of m - 1, differences strictly under r; NaN without matches."""
    n = len(x)
    close = np.abs(x[:, None] - x[None, :]) < r
    a = b = 0
    runs = np.zeros((n, n), np.int64)
    for k in range(n):
        # runs along diagonals: matches that end in row k
        runs[k, k + 1 :] = 0
    previous = np.zeros(n + 1, np.int64)
    for i in range(n - 1):
        now = np.zeros(n + 1, np.int64)
        hit = close[i, i + 1 :]
        now[: n - 1 - i] = np.where(hit, previous[: n - 1 - i] + 1, 0)
        a += int((now[: n - 1 - i] >= m).sum())
        b += int((now[: n - 2 - i] >= m - 1).sum())
        previous = now
    if m == 1:
        b = n * (n - 1) / 2
    return -math.log(a / b) if a and b else float("nan")


# -- wavelets ---------------------------------------------------------------


def daubechies(moments: int) -> np.ndarray:
    """Low-pass reconstruction taps with so many vanishing moments, by spectral factorisation."""
    coefficients = [math.comb(moments - 1 + k, k) for k in range(moments)]
    roots = []
    for y in np.roots(coefficients[::-1]) if moments > 1 else []:
        z = np.roots([1, 4 * y - 2, 1])
        roots.append(z[np.argmin(np.abs(z))])
    taps = np.real(np.poly(np.concatenate([-np.ones(moments), roots])))
    return taps * math.sqrt(2) / taps.sum()


# Low-pass reconstruction taps of the coiflet with eight vanishing moments.
COIFLET_4 = (
    0.0008923136685823146, -0.0016294920126017326, -0.0073461663276420815, 0.016068943964776348, 0.026682300156053072, -0.08126669968087875,
    -0.05607731331675481, 0.41530840703043026, 0.7822389309206135, 0.4343860564914685, -0.06662747426342504, -0.09622044203398831,
    0.03933442712333749, 0.025082261844864097, -0.015211731527946259, -0.00565828668661072, 0.003751436157278457, 0.0012665619292980445,
    -0.0005890207562443383, -0.00025997455248771324, 6.233903446100713e-05, 3.1229875865345646e-05, -3.2596802368833675e-06, -1.7849850030882614e-06,
)


def wavelet(name: str) -> np.ndarray:
    """Low-pass reconstruction taps of coif4, or of dbN for N vanishing moments."""
    if name == "coif4":
        return np.array(COIFLET_4)
    if name.startswith("db") and name[2:].isdigit() and int(name[2:]):
        return daubechies(int(name[2:]))
    raise ValueError(f"unknown wavelet: {name}")


def wavelet_levels(x: np.ndarray, taps: np.ndarray, levels: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Approximation and details (coarsest first), ends extended by half-sample symmetry."""
    low, high = taps[::-1], taps * np.where(np.arange(len(taps)) % 2, 1, -1)
    details = []
    for _ in range(levels):
        n = len(taps)
        wide = np.pad(x, n - 1, mode="symmetric")
        size = (len(x) + n - 1) // 2
        full = lambda f: np.convolve(wide, f, "valid")[1::2][:size]  # noqa: B023, E731
        details.append(full(high))
        x = full(low)
    return x, details[::-1]


def from_levels(a: np.ndarray, details: list[np.ndarray], taps: np.ndarray) -> np.ndarray:
    high = (taps * np.where(np.arange(len(taps)) % 2, 1, -1))[::-1]
    for d in details:
        a = a[: len(d)]
        up = lambda v, f: np.convolve(np.column_stack([v, np.zeros(len(v))]).ravel()[:-1], f, "full")
        size = 2 * len(d) - len(taps) + 2
        whole = up(a, taps) + up(d, high)
        a = whole[len(taps) - 2 : len(taps) - 2 + size]
    return a


def detail_power(x: np.ndarray, fs: float, taps: np.ndarray, low: float = 1.0, high: float = 3.0) -> tuple[float, float]:
    """Energy of the detail levels in a band by upward zero crossings of what they rebuild, and by the signal's energy."""
    most, least = math.ceil(math.log2(fs / low)), math.ceil(math.log2(fs / high))
    a, details = wavelet_levels(x, taps, most)
    kept = most - least + 1
    energy = float(sum((d**2).sum() for d in details[:kept]))
    details = [d if i < kept else np.zeros_like(d) for i, d in enumerate(details)]
    rebuilt = from_levels(a, details, taps)
    crossings = max(float((np.diff(np.sign(rebuilt)) > 0).sum()), 1e-10)
    return energy / crossings, energy / float((x**2).sum())


# -- other sequences --------------------------------------------------------


def fit_sphere(points: np.ndarray, temperature: np.ndarray, most: int = 1000, tolerance: float = 1e-10, populated: float = 0.3):
    """Offset, scale and temperature scale that bring still points (in g) onto the unit sphere.

    Iterated weighted regressions of the nearest points of the sphere.  Returns
    also whether the error fell, to under 0.01 g.
    """
    offset, scale, warm = np.zeros(3), np.ones(3), np.zeros(3)
    if len(points) < 2 or not ((points.min(axis=0) < -populated) & (points.max(axis=0) > populated)).all():
        return offset, scale, warm, False
    error = lambda p: round(float(np.abs(np.linalg.norm(p, axis=1) - 1).mean()), 5)
    t = temperature - temperature.mean()
    weights, last = np.full(len(points), 100.0), np.inf
    for _ in range(most):
        now = (points + offset) * scale + t[:, None] * warm
        near = now / np.linalg.norm(now, axis=1, keepdims=True)
        shift, stretch, heat = np.zeros(3), np.ones(3), np.zeros(3)
        root = np.sqrt(weights)
        for k in range(3):
            design = np.column_stack([np.ones(len(t)), now[:, k], t])
            shift[k], stretch[k], heat[k] = np.linalg.lstsq(design * root[:, None], near[:, k] * root, rcond=None)[0]
            now[:, k] = now[:, k] * stretch[k] + t * heat[k]
        if not (np.isfinite(shift) & np.isfinite(stretch) & np.isfinite(heat) & (np.abs(scale * stretch) > 1e-6)).all() or not np.isfinite(now).all() or np.abs(now).max() > 1e6:
            return offset, scale, warm, False  # diverges: these points lie on no ellipsoid
        offset = offset + shift / (scale * stretch)
        warm = warm * stretch + heat
        scale = scale * stretch
        residual = 3 * float((weights[:, None] * (now - near) ** 2).mean() / weights.sum())
        weights = np.minimum(1 / np.maximum(np.linalg.norm(now - near, axis=1), 1e-12), 100)
        if abs(last - residual) < tolerance:
            break
        last = residual
    end = error((points + offset) * scale + t[:, None] * warm)
    return offset, scale, warm, end < error(points) and end < 0.01
