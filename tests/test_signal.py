import io
import wave

import numpy as np
import pytest

from tessitura.models import gmm
from tessitura.signal import kernels as K
from tessitura.sources import binary as B


def tone(fs=8000, seconds=1.0, f=440.0, seed=0):
    t = np.arange(int(fs * seconds)) / fs
    return np.sin(2 * np.pi * f * t) + 0.01 * np.random.default_rng(seed).normal(size=len(t))


def test_scales_invert():
    f = np.linspace(20, 7900, 50)
    for htk in (True, False):
        assert np.allclose(K.mel_to_hz(K.hz_to_mel(f, htk), htk), f)
    assert np.allclose(K.bark_to_hz(K.hz_to_bark(f)), f)
    assert abs(K.hz_to_mel(1000) - 1000) < 1


def test_framing_and_emphasis():
    x = np.arange(10.0)
    assert K.frame_signal(x, 4, 2).tolist() == [[0, 1, 2, 3], [2, 3, 4, 5], [4, 5, 6, 7], [6, 7, 8, 9]]
    assert K.frame_signal(x, 4, 3, "zeros")[-1].tolist() == [6, 7, 8, 9]
    assert K.frame_signal(x, 4, 4, "edge")[-1].tolist() == [8, 9, 9, 9]
    assert K.frame_signal(x, 4, 4, "wrap")[-1].tolist() == [8, 9, 0, 1]
    assert K.frame_signal(x[:3], 4, 2).shape == (0, 4)
    assert np.allclose(K.emphasize(x, 0.5), np.concatenate([[0], x[1:] - 0.5 * x[:-1]]))


def test_power_spectrum_peaks_at_the_tone():
    spec, energy = K.power_spectrum(tone(), 8000)
    assert abs(spec.mean(0).argmax() * 8000 / 256 - 440) < 8000 / 256
    assert len(spec) == len(energy) == (8000 - 200) // 80 + 1


@pytest.mark.parametrize("n_lin,n_log", [(10, 0), (0, 24), (6, 10)])
def test_filter_bank(n_lin, n_log):
    bank, edges = K.filter_bank(16000, 512, 100, 8000, n_lin, n_log)
    assert bank.shape == (n_lin + n_log, 257) and (bank >= 0).all() and (np.diff(edges) > 0).all()
    assert (bank.sum(1) * 16000 / 512)[edges[2:] - edges[:-2] > 200].min() > 0.9


def test_mfcc_and_plp():
    x = tone()
    m = K.mfcc(x, 8000, high=4000)
    assert m["cep"].shape == (98, 13) and np.isfinite(m["cep"]).all() and m["fb"].shape[1] == 24
    full = m["fb"] @ K.dct_matrix(24, 24).T
    assert np.allclose(full[:, 1:14], m["cep"]) and np.allclose(full @ K.dct_matrix(24, 24), m["fb"])
    for r in (True, False):
        p = K.plp(x, 8000, use_rasta=r)
        assert p["cep"].shape == (98, 13) and np.isfinite(p["cep"]).all()


def test_levinson_solves_the_normal_equations():
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    r = np.array([[x[: 400 - k] @ x[k:] for k in range(6)]])
    a, e, _ = K.levinson(r, 5)
    toep = np.array([[r[0, abs(i - j)] for j in range(5)] for i in range(5)])
    assert np.allclose(toep @ a[0, 1:], -r[0, 1:]) and abs(e[0] - r[0] @ a[0]) < 1e-8


def test_prediction_round_trips():
    spec = np.abs(np.random.default_rng(1).normal(size=(3, 21))) + 1
    a = K.linear_prediction(spec, 8)
    s = K.prediction_to_spectra(a, 21)
    assert s.shape == spec.shape and (s > 0).all()
    c = K.prediction_to_cepstra(a, 60)
    z = np.exp(-1j * np.pi * np.outer(np.arange(21) / 20, np.arange(60)))
    assert np.allclose(np.exp(2 * (c[:, 1:] @ z[:, 1:].T).real), s * a[:, :1], rtol=1e-3)
    assert np.allclose(K.lifter(K.lifter(c, 0.6), 0.6, True), c) and np.allclose(K.lifter(K.lifter(c, -22), -22, True), c)


def test_mu_law_of_a_sine_and_levels():
    codes = np.arange(256)
    lin = K.mu_law_to_linear(codes)
    assert lin[255] == 0 and (np.diff(np.abs(lin[128:])) <= 0).all() and np.allclose(lin[:128], -lin[128:])
    assert abs(np.abs(lin).max() * 4004.189931 - 8031) < 1e-6
    noisy = K.add_noise(tone(), np.random.default_rng(0).normal(size=300), 10, 1)
    assert len(noisy) == 8000 and abs(noisy.std() - 1) < 1e-9
    speech = np.concatenate([tone(), np.zeros(8000)]) * 0.1
    assert abs(K.active_level(speech, 8000) - K.rms_db(speech[:8000])) < 2
    assert abs(K.active_level(K.add_reverb(speech, np.array([1.0, 0, 0.5]), 8000), 8000) + 26) < 0.1


def test_decimate_keeps_low_and_drops_high_tones():
    low, high = K.decimate(tone(16000, 1, 300), 2), K.decimate(tone(16000, 1, 7000), 2)
    assert len(low) == 8000 and low.std() > 0.6 and high.std() < 0.05


def test_vad_snr_finds_the_loud_part():
    x = np.concatenate([np.zeros(8000), tone(), np.zeros(8000)]) + 1e-3 * np.random.default_rng(0).normal(size=24000)
    v = K.vad_snr(x, 30, 8000, size=200)
    assert v[110:190].mean() > 0.8 and v[:90].mean() < 0.2
    assert len(K.enhance(x, 8000)) == len(x)


def test_audio_codecs():
    x = tone()[:500] * 0.5
    for a in (B.decode_wav(B.encode_wav(x, 8000)), B.decode_pcm(B.encode_pcm(x))):
        assert a.rate == 8000 and np.abs(a.samples[0] - x).max() < 1e-3
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2), w.setsampwidth(3), w.setframerate(16000)
        w.writeframes(b"".join(int(v).to_bytes(3, "little", signed=True) for v in (1, -2, 8388607, -8388608)))
    a = B.decode_wav(out.getvalue())
    assert a.samples.shape == (2, 2) and a.samples[1, 1] == -1.0 and abs(a.samples[0, 1] - 1) < 1e-6
    head = b"NIST_1A\n   1024\nsample_rate -i 8000\nchannel_count -i 2\nsample_n_bytes -i 2\nsample_byte_format -s2 10\nsample_coding -s3 pcm\nend_head\n"
    s = B.decode_sphere(head.ljust(1024) + np.array([1, -1, 2, -2], dtype=">i2").tobytes())
    assert s.samples.tolist() == [[1 / 32768, 2 / 32768], [-1 / 32768, -2 / 32768]]
    with pytest.raises(ValueError):
        B.decode_sphere(head.replace(b"-s3 pcm", b"-s26 pcm,embedded-shorten-v2.00").ljust(1024))
    assert B.decode_audio("a.wav", B.encode_wav(tone(16000), 16000), 8000).samples.shape == (1, 8000)
    with pytest.raises(ValueError):
        B.decode_audio("a.wav", B.encode_wav(x, 8000), 16000)


def test_frame_and_vector_codecs():
    x = np.random.default_rng(0).normal(size=(7, 5)).astype(np.float32)
    assert np.array_equal(B.decode_spro(B.encode_spro(x)), x)
    assert np.array_equal(B.decode_spro(b"<header>\na = 1;\n</header>\n" + B.encode_spro(x)), x)
    y, period, kind = B.decode_htk(B.encode_htk(x))
    assert np.array_equal(y, x) and period == 100000 and kind == 9
    assert np.allclose(B.decode_matrix(B.encode_matrix(x)), x)
    m = gmm.Mixture(np.array([0.3, 0.7]), np.arange(6.0).reshape(2, 3), np.ones((2, 3)) * 2)
    n = B.decode_raw_mixture(B.encode_raw_mixture(m))
    assert np.allclose(n.mu, m.mu) and np.allclose(n.cov, m.cov) and np.allclose(n.w, m.w)
    text = "~h \"x\" <NUMMIXES> 2 <MIXTURE> 1 0.25 <MEAN> 2\n 1 2 <VARIANCE> 2 3 4 <GCONST> 1 <MIXTURE> 2 0.75 <MEAN> 2 5 6 <VARIANCE> 2 7 8"
    h = B.parse_htk_mixture(text)
    assert h.w.tolist() == [0.25, 0.75] and h.mu.tolist() == [[1, 2], [5, 6]] and h.cov.tolist() == [[3, 4], [7, 8]]
    with pytest.raises(ValueError):
        B.parse_htk_mixture("<INVCOVAR> 2")
