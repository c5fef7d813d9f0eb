"""NumPy kernels for what DataFrame operations cannot express: transforms and recursive filters."""

from __future__ import annotations

import numpy as np


class SignalError(ValueError):
    """A record that an operator does not accept."""


def window_weights(kind: str | tuple, n: int, periodic: bool = True) -> np.ndarray:
    """Weights of a named window; ``(kind, parameter)`` is accepted for kaiser and gaussian."""
    name, parameter = kind if isinstance(kind, tuple) else (kind, None)
    if n == 1:
        return np.ones(1)
    size = n + 1 if periodic else n
    i = np.arange(size)
    x = i / (size - 1)
    if name in ("boxcar", "rectangular"):
        w = np.ones(size)
    elif name == "hann":
        w = 0.5 - 0.5 * np.cos(2 * np.pi * x)
    elif name == "hamming":
        w = 0.54 - 0.46 * np.cos(2 * np.pi * x)
    elif name == "blackman":
        w = 0.42 - 0.5 * np.cos(2 * np.pi * x) + 0.08 * np.cos(4 * np.pi * x)
    elif name == "bartlett":
        w = 1 - np.abs(2 * x - 1)
    elif name == "kaiser" and parameter is not None:
        w = np.kaiser(size, parameter)
    elif name == "gaussian" and parameter is not None:
        w = np.exp(-0.5 * ((i - (size - 1) / 2) / parameter) ** 2)
    else:
        raise SignalError(f"Unsupported window '{kind}'.")
    return w[:n]


def one_sided(x: np.ndarray, rate: float, remove_mean: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and one-sided amplitudes of the rows of x (any leading shape)."""
    n = x.shape[-1]
    if remove_mean:
        x = x - x.mean(axis=-1, keepdims=True)
    m = np.abs(np.fft.rfft(x, axis=-1)) / n
    if m.shape[-1] > 1:
        m[..., 1 : m.shape[-1] - (n % 2 == 0)] *= 2
    return np.fft.rfftfreq(n, 1.0 / rate), m


def frames(x: np.ndarray, size: int, step: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, size, axis=-1)[..., ::step, :]


def density(x: np.ndarray, rate: float, weights: np.ndarray) -> np.ndarray:
    """One-sided power density of the rows of x, constant detrended and tapered."""
    n = x.shape[-1]
    f = np.fft.rfft((x - x.mean(axis=-1, keepdims=True)) * weights, axis=-1)
    p = (f.real**2 + f.imag**2) / (rate * np.sum(weights**2))
    if p.shape[-1] > 1:
        p[..., 1 : p.shape[-1] - (n % 2 == 0)] *= 2
    return p


def welch(x: np.ndarray, rate: float, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean density of half-overlapping Hann segments."""
    n = x.shape[-1]
    size = min(1024, n) if size is None else min(size, n)
    got = frames(x, size, size - size // 2)
    return np.fft.rfftfreq(size, 1.0 / rate), density(got, rate, window_weights("hann", size)).mean(axis=-2)


def frame_sizes(n: int, rate: float, window_seconds: float, step_seconds: float | None) -> tuple[int, int]:
    """(samples in a frame, samples between frames); the step defaults to half a frame."""
    if window_seconds <= 0 or (step_seconds is not None and step_seconds <= 0):
        raise SignalError("window_seconds and step_seconds must be positive.")
    step_seconds = window_seconds / 2 if step_seconds is None else step_seconds
    if step_seconds > window_seconds:
        raise SignalError("step_seconds must not exceed window_seconds.")
    size = max(1, round(window_seconds * rate))
    if size > n:
        raise SignalError("window is longer than the signal.")
    return size, max(1, round(step_seconds * rate))


def stft(x: np.ndarray, rate: float, window_seconds: float = 0.1, step_seconds: float | None = None, window="hann"):
    """(frequencies, times, complex coefficients as frame x bin), scaled by the window's sum."""
    size, step = frame_sizes(x.size, rate, window_seconds, step_seconds)
    w = window_weights(window, size)
    got = frames(x, size, step)
    times = (size / 2 + step * np.arange(len(got))) / rate
    return np.fft.rfftfreq(size, 1 / rate), times, np.fft.rfft(got * w, axis=-1) / w.sum()


def spectrogram(x: np.ndarray, rate: float, window_seconds: float = 0.1, step_seconds: float | None = None, window="hann"):
    """(frequencies, times, power density as frame x bin)."""
    size, step = frame_sizes(x.size, rate, window_seconds, step_seconds)
    got = frames(x, size, step)
    times = (size / 2 + step * np.arange(len(got))) / rate
    return np.fft.rfftfreq(size, 1 / rate), times, density(got, rate, window_weights(window, size))


def analytic(x: np.ndarray) -> np.ndarray:
    n = x.size
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * gain)


def hilbert(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(analytic signal, envelope, unwrapped phase, instantaneous frequency)."""
    z = analytic(x)
    phase = np.unwrap(np.angle(z))
    if x.size == 1:
        return z, np.abs(z), phase, np.zeros(1)
    speed = np.diff(phase) * rate / (2 * np.pi)
    return z, np.abs(z), phase, np.append(speed, speed[-1])


def morlet(x: np.ndarray, rate: float, frequencies: np.ndarray, bandwidth: float = 1.5, centre: float = 1.0):
    """(widths, complex coefficients as frequency x sample) of a complex Morlet transform."""
    if np.any(frequencies <= 0) or np.any(frequencies > rate / 2):
        raise SignalError("frequencies must be positive and at most the Nyquist frequency.")
    widths = centre * rate / frequencies
    out = np.empty((len(frequencies), x.size), np.complex128)
    for k, width in enumerate(widths):
        half = int(np.ceil(8 * width))
        t = np.arange(-half, half + 1) / width
        psi = np.exp(2j * np.pi * centre * t) * np.exp(-(t**2) / bandwidth) / np.sqrt(np.pi * bandwidth * width)
        size = 1 << int(np.ceil(np.log2(x.size + psi.size - 1)))
        full = np.fft.ifft(np.fft.fft(x, size) * np.fft.fft(np.conj(psi[::-1]), size))
        out[k] = full[half : half + x.size]
    return widths, out


def butterworth(kind: str, order: int, rate: float, low: float | None, high: float | None) -> np.ndarray:
    """Second-order sections of a digital Butterworth filter by the bilinear transform."""
    kind = kind.lower()
    nyquist = rate / 2
    if order <= 0:
        raise SignalError("order must be positive.")
    for cut in {"lowpass": [high], "highpass": [low], "bandpass": [low, high]}.get(kind, [None]):
        if cut is None or not 0 < cut < nyquist:
            raise SignalError("cutoffs must lie between 0 and the Nyquist frequency.")
    if kind == "bandpass" and low >= high:
        raise SignalError("low_cut_hz must be below high_cut_hz.")
    k = np.arange(order)
    poles = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    warp = lambda f: 2 * np.tan(np.pi * f / rate)
    if kind == "lowpass":
        w = warp(high)
        p, z = poles * w, np.zeros(0)
        gain = w**order
    elif kind == "highpass":
        w = warp(low)
        p, z = w / poles, np.zeros(order)
        gain = 1.0
    else:
        a, b = warp(low), warp(high)
        half = poles * (b - a) / 2
        root = np.sqrt(half**2 - a * b + 0j)
        p, z = np.concatenate([half + root, half - root]), np.zeros(order)
        gain = (b - a) ** order
    gain = gain * np.real(np.prod(2 - z) / np.prod(2 - p))
    pz, zz = (2 + p) / (2 - p), (2 + z) / (2 - z)
    zz = np.concatenate([zz, -np.ones(len(pz) - len(zz))])
    return _sections(pz, np.sort(zz.real), float(gain))


def _sections(poles: np.ndarray, zeros: np.ndarray, gain: float) -> np.ndarray:
    """Pair poles into sections: conjugates together, real ones two by two."""
    upper = sorted([p for p in poles if p.imag > 1e-12], key=lambda p: abs(p))
    real = sorted([p.real for p in poles if abs(p.imag) <= 1e-12])
    pairs = [(1.0, -2 * p.real, abs(p) ** 2) for p in upper]
    for i in range(0, len(real) - 1, 2):
        pairs.append((1.0, -(real[i] + real[i + 1]), real[i] * real[i + 1]))
    if len(real) % 2:
        pairs.append((1.0, -real[-1], 0.0))
    low, high = list(zeros[: len(zeros)]), []
    sections = []
    for a in pairs:
        if a[2] == 0.0 and len(low) % 2:
            z = low.pop(len(low) // 2)
            b = (1.0, -z, 0.0)
        else:
            z1 = low.pop(0)
            z2 = low.pop() if low else 0.0
            b = (1.0, -(z1 + z2), z1 * z2)
        sections.append([*b, *a])
    out = np.array(sections)
    out[0, :3] *= gain
    return out


def sos_filter(sos: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """Cascade of second-order sections along the last axis (direct form II transposed).

    ``state`` is section x 2 x rows.  All rows run at once, and blocks of samples side by side.
    """
    rows = np.array(x, np.float64, copy=True).reshape(-1, x.shape[-1])
    for k, section in enumerate(sos):
        start = np.zeros((2, len(rows))) if state is None else state[k]
        rows = _section(section, rows, start)
    return rows.reshape(x.shape)


def _section(section: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """One section: blocks from rest in step, then each block's answer to the state before it."""
    b0, b1, b2, _, a1, a2 = section
    count, n = x.shape
    size = max(1, int(np.sqrt(n)))
    blocks = -(-n // size)
    v = np.zeros((count, blocks * size))
    v[:, :n] = x
    v = v.reshape(count * blocks, size)
    out = np.empty_like(v)
    s1, s2 = np.zeros(len(v)), np.zeros(len(v))
    # the last two columns are the answers to either unit state
    rest = np.empty((size, 2))
    u1, u2 = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    for i in range(size):
        o = b0 * v[:, i] + s1
        s1, s2 = b1 * v[:, i] - a1 * o + s2, b2 * v[:, i] - a2 * o
        out[:, i] = o
        rest[i] = u1
        u1, u2 = -a1 * u1 + u2, -a2 * u1
    end = np.stack([s1, s2], axis=-1).reshape(count, blocks, 2)
    step = np.stack([u1, u2])  # a block's last state from the first one
    begin = np.empty((count, blocks, 2))
    now = state.T
    for k in range(blocks):
        begin[:, k] = now
        now = end[:, k] + now @ step.T
    out = out.reshape(count, blocks, size) + begin @ rest.T
    return out.reshape(count, blocks * size)[:, :n]


def steady_state(sos: np.ndarray) -> np.ndarray:
    """Section states (section x 2) for which a constant 1 gives a constant output."""
    out, scale = np.zeros((len(sos), 2)), 1.0
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        out[k] = np.array([gain - b0, b2 - a2 * gain]) * scale
        scale *= gain
    return out


def pad_length(sos: np.ndarray) -> int:
    n = 2 * len(sos) + 1
    n -= min((sos[:, 2] == 0).sum(), (sos[:, 5] == 0).sum())
    return 3 * int(n)


def zero_phase(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward filtering of the rows of x with an odd extension of both ends."""
    pad = pad_length(sos)
    if x.shape[-1] <= pad:
        raise SignalError("The record is too short for zero-phase filtering.")
    rows = x.reshape(-1, x.shape[-1])
    ext = np.concatenate([2 * rows[:, :1] - rows[:, pad:0:-1], rows, 2 * rows[:, -1:] - rows[:, -2 : -pad - 2 : -1]], axis=1)
    start = steady_state(sos)[:, :, None]
    y = sos_filter(sos, ext, start * ext[:, 0])
    y = sos_filter(sos, y[:, ::-1], start * y[:, -1])[:, ::-1]
    return y[:, pad:-pad].reshape(x.shape)


def band_sum(freq: np.ndarray, magnitude: np.ndarray, n: int, low: float, high: float, nyquist: float) -> np.ndarray:
    """Energy of one-sided amplitudes in [low, high), closed at the Nyquist frequency."""
    power = magnitude**2
    power[..., 1 : power.shape[-1] - (n % 2 == 0)] /= 2
    inside = (freq >= low) & ((freq <= high) if np.isclose(high, nyquist) else (freq < high))
    return power[..., inside].sum(axis=-1)
