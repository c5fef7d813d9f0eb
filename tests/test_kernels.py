import numpy as np
import pytest

from sigloom.functions import kernels as K


def sine(f, fs=1000.0, seconds=1.0, a=1.0):
    return a * np.sin(2 * np.pi * f * np.arange(int(fs * seconds)) / fs)


def test_amplitude_and_band_energy_of_a_sine():
    f, m = K.one_sided(sine(50, a=2.0), 1000.0)
    assert f[m.argmax()] == 50 and m.max() == pytest.approx(2.0)
    assert K.band_sum(f, m.copy(), 1000, 45, 55, 500) == pytest.approx(2.0)
    assert K.band_sum(f, m.copy(), 1000, 0, 50, 500) == pytest.approx(0.0, abs=1e-12)


def test_band_energies_sum_to_the_variance():
    x = np.random.default_rng(1).normal(size=501)
    f, m = K.one_sided(x, 100.0)
    assert K.band_sum(f, m, 501, 0, 50, 50) == pytest.approx(x.var())


def test_welch_peak_and_spectrogram_frames():
    f, p = K.welch(sine(80, seconds=2.0), 1000.0, 1000)
    assert abs(f[p.argmax()] - 80) <= 1
    f, t, p = K.spectrogram(sine(80), 1000.0, 0.1)
    assert p.shape == (19, 51) and t[0] == pytest.approx(0.05)
    with pytest.raises(K.SignalError):
        K.spectrogram(sine(80), 1000.0, 2.0)
    with pytest.raises(K.SignalError):
        K.spectrogram(sine(80), 1000.0, 0.1, 0.2)


@pytest.mark.parametrize("kind,low,high", [("lowpass", None, 50.0), ("highpass", 50.0, None), ("bandpass", 150.0, 250.0)])
def test_butterworth_passes_and_stops(kind, low, high):
    sos = K.butterworth(kind, 4, 1000.0, low, high)
    two = sine(20, seconds=2.0) + sine(200, seconds=2.0)
    y = K.zero_phase(sos, two)
    f, m = K.one_sided(y, 1000.0)
    low_tone, high_tone = m[np.isclose(f, 20)][0], m[np.isclose(f, 200)][0]
    assert (low_tone > 0.95) == (kind == "lowpass") and (high_tone > 0.9) == (kind != "lowpass")
    assert min(low_tone, high_tone) < 0.05


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_butterworth_is_3_db_down_at_the_cut(order):
    sos = K.butterworth("lowpass", order, 1000.0, None, 100.0)
    z = np.exp(1j * 2 * np.pi * 100 / 1000)
    h = np.prod([(b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2) for b0, b1, b2, _, a1, a2 in sos])
    assert abs(h) == pytest.approx(2**-0.5, rel=1e-6)


def test_filter_rejects_bad_cuts_and_short_records():
    with pytest.raises(K.SignalError):
        K.butterworth("lowpass", 4, 100.0, None, 60.0)
    with pytest.raises(K.SignalError):
        K.zero_phase(K.butterworth("lowpass", 4, 100.0, None, 10.0), np.ones(5))


def test_hilbert_and_scalogram():
    _, envelope, _, speed = K.hilbert(sine(25, seconds=2.0), 1000.0)
    assert np.median(envelope) == pytest.approx(1.0, rel=0.01) and np.median(speed) == pytest.approx(25, rel=0.01)
    _, z = K.morlet(sine(40, 500.0), 500.0, np.array([20.0, 40.0, 80.0]))
    assert z.shape == (3, 500) and (np.abs(z) ** 2).mean(axis=1).argmax() == 1
