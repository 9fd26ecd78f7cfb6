"""Spectral features of one signal as numpy functions: framing, filter banks, cepstra, linear prediction."""

from __future__ import annotations

import numpy as np

from tessitura.functions.filters import one_pole
from tessitura.operators.frames import dct_matrix

# -- frequency scales -----------------------------------------------------------------------------


def hz_to_mel(f: np.ndarray | float, htk: bool = True) -> np.ndarray:
    """HTK: 2595 log10(1 + f / 700). Otherwise linear below 1 kHz (200/3 Hz a step), logarithmic above."""
    f = np.asarray(f, dtype=np.float64)
    if htk:
        return 2595 * np.log10(1 + f / 700)
    step = np.exp(np.log(6.4) / 27)
    return np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000) / np.log(step))


def mel_to_hz(z: np.ndarray | float, htk: bool = True) -> np.ndarray:
    z = np.asarray(z, dtype=np.float64)
    if htk:
        return 700 * (10 ** (z / 2595) - 1)
    step = np.exp(np.log(6.4) / 27)
    return np.where(z < 15, z * 200 / 3, 1000 * step ** (z - 15))


def hz_to_bark(f: np.ndarray | float) -> np.ndarray:
    return 6 * np.arcsinh(np.asarray(f, dtype=np.float64) / 600)


def bark_to_hz(z: np.ndarray | float) -> np.ndarray:
    return 600 * np.sinh(np.asarray(z, dtype=np.float64) / 6)


# -- framing and spectra --------------------------------------------------------------------------


def frame_signal(x: np.ndarray, size: int, shift: int, pad: str = "none") -> np.ndarray:
    """(frames, size): full frames every ``shift`` samples; with pad='zeros', 'edge' or 'wrap' a last partial one
    too, filled with zeros, the last sample or the beginning of the signal."""
    x = np.asarray(x)
    if pad != "none" and len(x):
        n = max(0, -(-(len(x) - size) // shift))
        short = max(0, n * shift + size - len(x))
        fill = {"zeros": lambda: np.zeros(short), "edge": lambda: np.full(short, x[-1]), "wrap": lambda: np.resize(x, short)}
        x = np.concatenate([x, fill[pad]()])
    if len(x) < size:
        return np.zeros((0, size))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::shift]


def emphasize(x: np.ndarray, a: float) -> np.ndarray:
    """x[t] - a x[t-1] along the last axis, x before the start being its first value."""
    return x - a * np.concatenate([x[..., :1], x[..., :-1]], axis=-1)


def fft_size(window: int) -> int:
    return 1 << int(np.ceil(np.log2(window)))


def power_spectrum(x: np.ndarray, fs: int, window: float = 0.025, shift: float = 0.01, preemphasis: float = 0.97) -> tuple[np.ndarray, np.ndarray]:
    """(power, log-energy) by frame; frames are emphasised, then Hann-windowed."""
    size = int(round(window * fs))
    f = emphasize(frame_signal(np.asarray(x, dtype=np.float64), size, int(shift * fs)), preemphasis)
    energy = np.log(np.maximum((f**2).sum(1), np.finfo(float).tiny))
    return np.abs(np.fft.rfft(f * np.hanning(size), fft_size(size), axis=1)) ** 2, energy


def triangles(edges: np.ndarray, fs: int, n_fft: int) -> np.ndarray:
    """(filters, bins): triangles of unit area between neighbouring edge frequencies."""
    f = np.arange(n_fft // 2 + 1) * fs / n_fft
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    shape = np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid))
    return np.maximum(shape, 0) * 2 / (hi - lo)


def band_edges(low: float, high: float, n_linear: int, n_log: int, middle: float = 1000.0) -> np.ndarray:
    """Edges of ``n_linear`` filters of equal width followed by ``n_log`` of equal width on the mel scale.

    In the mixed case filters move from the logarithmic to the linear part until the first logarithmic one
    is at least as wide as a linear one.
    """
    if n_log == 0:
        return np.linspace(low, high, n_linear + 2)
    if n_linear == 0:
        return mel_to_hz(np.linspace(hz_to_mel(low), hz_to_mel(high), n_log + 2))
    width, moved = (min(middle, high) - low) / (n_linear + 1), np.arange(n_log + 1)
    # where the logarithmic part begins, and the width of its filters in mel, for every number of moved filters
    begin = np.where(moved == 0, hz_to_mel(min(1000.0, high)), hz_to_mel(low + (n_linear + moved + 1) * width))
    step = (hz_to_mel(high) - begin) / (n_log - moved + 1)
    k = int(np.argmax((mel_to_hz(step) >= width) | (moved == n_log)))
    return np.concatenate([low + np.arange(n_linear + k) * width, mel_to_hz(begin[k] + np.arange(n_log - k + 2) * step[k])])


def filter_bank(fs: int, n_fft: int, low: float, high: float, n_linear: int, n_log: int) -> tuple[np.ndarray, np.ndarray]:
    """(filters, edges) of a triangular filter bank."""
    edges = band_edges(low, high, n_linear, n_log)
    return triangles(edges, fs, n_fft), edges


def sub_band_filter_bank(fs: int, n_fft: int, low: float, high: float, n_log: int, widest_low: float, widest_high: float) -> tuple[np.ndarray, np.ndarray]:
    """The filters of a wide mel bank whose edges lie in [low, high]."""
    edges = band_edges(widest_low, widest_high, 0, n_log)
    edges = edges[(edges >= low) & (edges <= high)]
    return triangles(edges, fs, n_fft), edges


# -- cepstra --------------------------------------------------------------------------------------


def mfcc(x: np.ndarray, fs: int = 16000, low: float = 100.0, high: float = 8000.0, n_linear: int = 0, n_log: int = 24, n_cep: int = 13, window: float = 0.025, shift: float = 0.01, preemphasis: float = 0.97) -> dict[str, np.ndarray]:
    """cep (coefficients 1 to ``n_cep``), energy, spec and fb (log filter outputs), one row a frame."""
    spec, energy = power_spectrum(x, fs, window, shift, preemphasis)
    bank, _ = filter_bank(fs, fft_size(int(round(window * fs))), low, min(high, fs / 2), n_linear, n_log)
    fb = np.log(np.maximum(spec @ bank.T, np.finfo(float).tiny))
    return {"cep": fb @ dct_matrix(fb.shape[1], n_cep + 1).T[:, 1:], "energy": energy, "spec": spec, "fb": fb}


def bark_weights(n_fft: int, fs: int, n: int, width: float = 1.0, low: float = 0.0, high: float = 8000.0) -> np.ndarray:
    """(n, bins): bands one bark apart, trapezoids on the bark scale with slopes of 10 and 25 dB."""
    high = min(high, fs / 2)
    mid = np.linspace(hz_to_bark(low), hz_to_bark(high), n)[:, None]
    z = hz_to_bark(np.arange(n_fft // 2 + 1) * fs / n_fft)
    return 10 ** (np.minimum(0, np.minimum(z - mid + 0.5, -2.5 * (z - mid - 0.5))) / width)


def mel_weights(n_fft: int, fs: int, n: int = 0, width: float = 1.0, low: float = 0.0, high: float = 4000.0, htk: bool = False, constant: bool = False) -> np.ndarray:
    """(n, bins): mel triangles, of unit area unless ``constant``; n = 0 gives one for every 100 mel."""
    a, b = hz_to_mel(low, htk), hz_to_mel(min(high, fs / 2), htk)
    n = n or int(np.ceil(hz_to_mel(fs / 2, True) / 100))
    edges = mel_to_hz(np.linspace(a, b, n + 2), htk)
    f = np.arange(n_fft // 2 + 1) * fs / n_fft
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    lo, hi = mid - width * (mid - lo), mid + width * (hi - mid)
    shape = np.maximum(0, np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid)))
    return shape if constant else shape * 2 / (hi - lo)


def auditory_spectrum(power: np.ndarray, fs: int, kind: str = "bark", n: int | None = None, low: float = 0.0, high: float = 8000.0, sum_power: bool = True) -> np.ndarray:
    """Critical-band energies; ``kind`` bark, mel, htkmel or fcmel."""
    n_fft, n = 2 * (power.shape[1] - 1), n or int(np.ceil(hz_to_bark(fs / 2))) + 1
    if kind == "bark":
        w = bark_weights(n_fft, fs, n, 1.0, low, high)
    elif kind in ("mel", "htkmel", "fcmel"):
        w = mel_weights(n_fft, fs, n, 1.0, low, high, kind != "mel", kind == "htkmel")
    else:
        raise ValueError(f"unknown kind {kind}")
    return power @ w.T if sum_power else (np.sqrt(power) @ w.T) ** 2


def loudness(bands: np.ndarray, f_max: float, kind: str = "bark", broaden: bool = False) -> np.ndarray:
    """Equal-loudness weighting and cube-root compression; the outer bands are replaced by their neighbours,
    or with ``broaden`` repeated."""
    n = bands.shape[1]
    points = n + 2 * broaden
    if kind == "bark":
        centre = bark_to_hz(np.linspace(0, hz_to_bark(f_max), points))
    else:
        centre = mel_to_hz(np.linspace(0, hz_to_mel(f_max, kind != "mel"), points), kind != "mel")
    sq = centre[broaden : points - broaden] ** 2
    # Constants of the equal-loudness curve and the exponent of compression.
    curve = (sq / (sq + 1.6e5)) ** 2 * (sq + 1.44e6) / (sq + 9.61e6)
    z = (bands * curve) ** 0.33
    inner = np.arange(n) if broaden else np.clip(np.arange(n), 1, n - 2)
    return z[:, np.concatenate([[0], inner, [n - 1]])] if broaden else z[:, inner]


def levinson(r: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, error, reflection) by row of autocorrelations: linear prediction of the given order, a[0] = 1."""
    r = np.atleast_2d(np.asarray(r, dtype=np.float64))
    a, e, k = np.zeros((len(r), order + 1)), r[:, 0].copy(), np.zeros((len(r), order))
    a[:, 0] = 1
    for m in range(1, order + 1):
        acc = r[:, m] + (a[:, 1:m] * r[:, m - 1 : 0 : -1]).sum(1)
        g = -np.divide(acc, e, out=np.zeros_like(acc), where=e > 1e-300)
        a[:, 1:m], a[:, m] = a[:, 1:m] + g[:, None] * a[:, m - 1 : 0 : -1], g
        e *= 1 - g**2
        k[:, m - 1] = g
    return a, e, k


def linear_prediction(bands: np.ndarray, order: int) -> np.ndarray:
    """All-pole polynomials of spectra, divided by their error."""
    full = np.concatenate([bands, bands[:, -2:0:-1]], axis=1)
    r = np.fft.ifft(full, axis=1).real[:, : bands.shape[1]]
    a, e, _ = levinson(r, order)
    return a / np.maximum(e, np.finfo(float).tiny)[:, None]


def prediction_to_cepstra(a: np.ndarray, n: int) -> np.ndarray:
    """Cepstra of all-pole polynomials; the first is the log of their error."""
    c = np.zeros((len(a), n))
    c[:, 0] = -np.log(a[:, 0])
    b = a / a[:, :1]
    for i in range(1, n):
        back = sum(((i - m) * b[:, m] * c[:, i - m] for m in range(1, min(i, b.shape[1]))), np.zeros(len(a)))
        c[:, i] = -(b[:, i] if i < b.shape[1] else 0) - back / i
    return c


def prediction_to_spectra(a: np.ndarray, n: int) -> np.ndarray:
    """Power spectra of all-pole polynomials at ``n`` points from 0 to the Nyquist frequency."""
    z = np.exp(-1j * np.pi * np.outer(np.arange(n) / (n - 1), np.arange(a.shape[1])))
    gain = a[:, :1]
    return 1 / np.abs((a / gain) @ z.T) ** 2 / gain


def spectra_to_cepstra(spectra: np.ndarray, n: int = 13) -> np.ndarray:
    """Orthonormal DCT of log spectra."""
    return np.log(np.maximum(spectra, np.finfo(float).tiny)) @ dct_matrix(spectra.shape[1], n).T


def lifter(c: np.ndarray, lift: float = 0.6, invert: bool = False) -> np.ndarray:
    """Cepstra times i ** lift; a negative integer is the length of a sine lifter."""
    i = np.arange(1, c.shape[1])
    w = np.ones(len(i)) if lift == 0 else i**lift if lift > 0 else 1 - lift / 2 * np.sin(np.pi * i / -lift)
    w = np.concatenate([[1.0], w])
    return c / w if invert else c * w


def rasta(x: np.ndarray) -> np.ndarray:
    """Band-pass filter along time (rows): numerator (.2, .1, 0, -.1, -.2), pole .94, first four rows zero."""
    fir = np.zeros_like(x, dtype=np.float64)
    for k, c in enumerate((0.2, 0.1, 0.0, -0.1, -0.2)):
        fir[k:] += c * x[: max(0, len(x) - k)]
    fir[:4] = 0
    return one_pole(fir, 0.94)


def plp(x: np.ndarray, fs: int = 16000, order: int = 13, window: float = 0.025, shift: float = 0.01, preemphasis: float = 0.97, use_rasta: bool = True) -> dict[str, np.ndarray]:
    """Perceptual linear prediction: cep, energy, spec and fb (compressed bands), one row a frame."""
    spec, energy = power_spectrum(x, fs, window, shift, preemphasis)
    bands = auditory_spectrum(spec, fs)
    if use_rasta:
        bands = np.exp(rasta(np.log(np.maximum(bands, np.finfo(float).tiny))))
    z = loudness(bands, fs / 2)
    cep = prediction_to_cepstra(linear_prediction(z, order - 1), order) if order > 1 else spectra_to_cepstra(z)
    return {"cep": lifter(cep), "energy": energy, "spec": spec, "fb": z}


# -- signals --------------------------------------------------------------------------------------


def mu_law_to_linear(codes: np.ndarray, scale: float = 4004.189931) -> np.ndarray:
    """Linear samples of 8-bit mu-law codes; with the default scale a full sine has mean square 1."""
    b = 255 - np.asarray(codes, dtype=np.int64)
    sign, exponent, mantissa = np.where(b >= 128, -1.0, 1.0), (b >> 4) & 7, b & 15
    return sign * (((2 * mantissa + 33) << exponent) - 33) / scale


def rms_db(x: np.ndarray) -> float:
    return float(20 * np.log10(np.sqrt(np.mean(np.asarray(x, dtype=np.float64) ** 2))))


def add_noise(x: np.ndarray, noise: np.ndarray, snr: float, seed: int = 0) -> np.ndarray:
    """Signal with a stretch of noise (repeated if short, seeded offset) at ``snr`` dB, standardised."""
    rng, n = np.random.default_rng(seed), len(x)
    noise = np.tile(noise, -(-n // len(noise)) + 1)
    at = int(rng.integers(0, len(noise) - n + 1))
    part = noise[at : at + n]
    y = x + part * 10 ** ((rms_db(x) - rms_db(part) - snr) / 20)
    return (y - y.mean()) / max(y.std(), 1e-12)


def active_level(x: np.ndarray, fs: int, hangover: float = 0.2, margin: float = 15.9, bits: int = 16) -> float:
    """Active speech level in dB: the level over the time the envelope is above a threshold ``margin`` dB below
    it, thresholds halving from full scale, with interpolation between them."""
    x = np.asarray(x, dtype=np.float64)
    g, hang = np.exp(-1 / (fs * 0.03)), int(np.ceil(hangover * fs))
    env = one_pole((1 - g) * one_pole((1 - g) * np.abs(x), g), g)
    sq, levels = float((x**2).sum()), []
    for c in 2.0 ** np.arange(-(bits - 1), 0):
        above = np.flatnonzero(env >= c)
        if len(above):
            active = np.minimum(np.diff(np.append(above, len(x))), hang + 1).sum()
            levels.append((10 * np.log10(sq / active), 20 * np.log10(c)))
    for (a0, c0), (a1, c1) in zip(levels, levels[1:]):
        d0, d1 = a0 - c0 - margin, a1 - c1 - margin
        if d0 >= 0 >= d1:
            t = d0 / (d0 - d1) if d0 != d1 else 0.0
            return a0 + t * (a1 - a0)
    return levels[0][0] if levels else -100.0


def add_reverb(x: np.ndarray, response: np.ndarray, fs: int, level: float = -26.0) -> np.ndarray:
    """Signal convolved with a room response, at an active level of ``level`` dB."""
    n = 1 << int(np.ceil(np.log2(len(x) + len(response))))
    y = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(response, n), n)[: len(x)]
    return y * 10 ** ((level - active_level(y, fs)) / 20)


def decimate(x: np.ndarray, factor: int, taps: int = 0) -> np.ndarray:
    """Every ``factor``-th sample after a windowed-sinc low-pass (zero phase)."""
    if factor == 1:
        return np.asarray(x, dtype=np.float64)
    taps = taps or 20 * factor + 1
    t = np.arange(taps) - taps // 2
    h = np.sinc(t / factor) * np.hamming(taps)
    return np.convolve(x, h / h.sum(), mode="same")[::factor]


def noise_level(amplitude: np.ndarray, start: float, memory: int = 40, blocks: int = 4, smooth: float = 0.9024) -> np.ndarray:
    """Minimum statistics: by frame and bin the smallest smoothed amplitude of the current block of ``memory`` frames so far
    and of the ``blocks`` - 1 blocks before it; blocks before the first one hold ``start``."""
    level = one_pole((1 - smooth) * amplitude, smooth)
    out, past = np.empty_like(level), [np.full(level.shape[1], start)] * (blocks - 1)
    first = np.full((1, level.shape[1]), start)  # the first block goes on from the start value and is one frame shorter
    at, n = 0, memory - 1
    while at < len(level):
        low = np.minimum.accumulate(np.concatenate([first, level[at : at + n]]))[len(first) :]
        out[at : at + n] = np.minimum(low, np.min(past, axis=0))
        past = [low[-1], *past[:-1]]
        at, n, first = at + n, memory, level[:0]
    return out


def enhance_minimum(x: np.ndarray, gain: float = 1.2, size: int = 64, lead: int = 200) -> np.ndarray:
    """Wiener enhancement with noise from minimum statistics, which see the first ``lead`` frames twice. The output is late by
    half a frame; signals below 512 samples come back as they are. Sounds that stay the same for 160 frames count as noise."""
    x = np.asarray(x, dtype=np.float64)
    if len(x) < 512:
        return x
    shift = size // 2
    n = -(-len(x) // shift)
    f = frame_signal(np.concatenate([np.zeros(shift), x, np.zeros(n * shift - len(x))]), size, shift)
    spec = np.fft.rfft(f * 1.08 * np.hamming(size), axis=1)
    amplitude = np.abs(spec)
    before = amplitude[: min(lead, len(x) // shift)]
    noise = 2 * gain * noise_level(np.concatenate([before, amplitude]), size / 2)[len(before) :]
    # Smoothing of the speech amplitude and the level of overlapping windows.
    keep, overlap = 0.75, 1.15
    out, last = np.empty_like(amplitude), np.zeros(amplitude.shape[1])
    over = (1 - keep) * np.maximum(amplitude - noise, 0)
    for t in range(len(amplitude)):
        speech = keep * last + over[t]
        out[t] = last = amplitude[t] * speech / np.maximum(speech + noise[t], 1e-300)
    y = np.fft.irfft(spec * out / (amplitude + np.spacing(1.0)), size, axis=1)
    y[1:, :shift] += y[:-1, shift:]
    return y[:, :shift].ravel()[: len(x)] / overlap


def enhance(x: np.ndarray, fs: int, floor: float = 0.05, window: float = 0.032, history: int = 60) -> np.ndarray:
    """Spectral-subtraction (Wiener) enhancement: the noise is the smoothed spectrum's minimum over the last frames."""
    size = fft_size(int(window * fs))
    shift, w = size // 2, np.hanning(size + 1)[:-1]
    padded = np.concatenate([np.zeros(shift), np.asarray(x, dtype=np.float64), np.zeros(size)])
    spec = np.fft.rfft(frame_signal(padded, size, shift) * w, axis=1)
    power = np.abs(spec) ** 2
    smooth = one_pole(np.concatenate([power[:1], 0.3 * power[1:]]), 0.7)
    noise = np.array([smooth[max(0, t - history) : t + 1].min(0) for t in range(len(smooth))]) * 1.5
    gain = np.maximum(1 - noise / np.maximum(power, 1e-20), floor)
    out, parts = np.zeros(len(padded)), np.fft.irfft(spec * gain, size, axis=1)
    for t, p in enumerate(parts):
        out[t * shift : t * shift + size] += p
    return out[shift : shift + len(x)]


def vad_snr(x: np.ndarray, snr: float, fs: int = 16000, shift: float = 0.01, size: int = 256, minimum: bool = False) -> np.ndarray:
    """Frames whose level after enhancement lies within ``snr`` dB of the loudest and above -75 dB; with ``minimum`` the
    enhancement is :func:`enhance_minimum`."""
    f = frame_signal(enhance_minimum(x) if minimum else enhance(x, fs), size, int(shift * fs))
    level = 20 * np.log10(np.maximum(f.std(1), 1e-12))
    return (level > level.max() - snr) & (level > -75) if len(level) else np.zeros(0, dtype=bool)
