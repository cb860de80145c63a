import hashlib
import zlib

import numpy as np
import pytest

from eventlake.llm import media


def test_files_round_trip():
    for raw in (b"", b"x", bytes(range(256)) * 9, b"a" * 576):
        payload = media.padded(raw)
        assert payload.startswith(raw) and len(payload) % 576 == 0 and len(payload) >= 576 and set(payload[len(raw) :]) <= {255}
        rate, samples = media.read_wav(media.wav(payload))
        assert rate == media.RATE and bytes(samples) == payload
    with pytest.raises(ValueError):
        media.read_wav(b"nothing of the kind")


@pytest.mark.parametrize(("up", "down"), [(1, 2), (3, 4), (2, 5), (2, 1), (1, 1), (5, 3)])
def test_resampling_matches_direct_form(up, down):
    x = np.random.default_rng(0).normal(size=301).astype(np.float32)
    got = media.resample(x, up, down, 8)
    n = up * 8
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hamming(n)
    h = h / h.sum() * up
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    want = np.convolve(stuffed, h)[: len(stuffed)][::down]
    assert len(got) == len(want) and np.allclose(got, want, atol=1e-4)


def test_log_mel_matches_direct_form():
    x = np.sin(np.arange(1000) * 0.3).astype(np.float32)
    mel, energy = media.log_mel(x)
    assert mel.shape == ((1000 - media.WINDOW) // media.HOP + 1, media.MELS)
    part = x[media.HOP : media.HOP + media.WINDOW]
    power = np.abs(np.fft.rfft(part * np.hanning(media.WINDOW), media.FFT)) ** 2
    want = np.maximum(media.FLOOR, np.log(power @ media.mel_bank(media.RATE * media.UP / media.DOWN) + 1e-6))
    assert np.allclose(mel[1], want, atol=1e-3) and abs(energy[1] - np.log((part**2).mean() + 1e-6)) < 1e-3
    assert media.log_mel(x[:10])[0].shape == (1, media.MELS)


def test_hysteresis():
    # begins above the upper bound, goes on between the bounds, ends below the lower one
    level = np.array([0, 0, 3, 1.4, 1.5, 0, 1.4, 3, 3, 0], float)
    z = (level - level.mean()) / (level.std() + 1e-6)
    want, on, out = [], False, []
    for v in z:
        on = True if v > media.BEGIN else False if v < media.END else on
        want.append(on)
    for i, v in enumerate(want):
        if v and (i == 0 or not want[i - 1]):
            out.append([i, i + 1])
        elif v:
            out[-1][1] = i + 1
    assert media.segments(level) == [tuple(s) for s in out]
    assert media.segments(np.ones(5)) == []


def test_tensors():
    mel = np.arange(70 * media.MELS, dtype=np.float32).reshape(70, media.MELS)
    table = media.from_ipc(media.to_ipc(media.patches(mel)))
    tensor = table.column("log_mel").combine_chunks()
    values = tensor.to_numpy_ndarray()
    assert values.shape == (3, media.PATCH, media.MELS) and np.array_equal(values.reshape(-1, media.MELS)[:70], mel)
    assert (values.reshape(-1, media.MELS)[70:] == media.FLOOR).all()
    ms = 1000 * media.HOP * media.DOWN / (media.RATE * media.UP)
    assert table.column("start_ms").to_pylist() == [0, 32 * ms, 64 * ms] and table.column("end_ms").to_pylist() == [32 * ms, 64 * ms, 70 * ms]


def test_query(spark, sf, texts):
    from eventlake.llm.queries import op7_audio_features

    rows = op7_audio_features(spark, sf).collect()
    assert len(rows) == len(texts)
    seen = {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        file = media.wav(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(file))
        assert (r["payload_sha256"], r["media_sha256"]) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(file).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert seen.setdefault(raw, r["feature"]) == r["feature"]


def test_odd_rows(odd_docs, no_docs):
    rows = media.digests(media.encode(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    assert {r["payload_bytes"] for r in rows if r["doc_id"] in (1, 2)} == {576}
    assert len({tuple(r)[1:] for r in rows if r["doc_id"] in (5, 6)}) == 1
    assert media.digests(media.encode(no_docs)).collect() == []


def test_the_last_bytes_reach_the_features():
    for units in range(1, 8):
        raw = bytes(np.random.default_rng(units).integers(32, 127, 576 * units, dtype=np.uint8))
        mel, _ = media.analyse(media.wav(raw))
        assert (len(mel) - 1) * media.HOP + media.WINDOW >= len(raw) * media.UP // media.DOWN
        for back in (1, 2, 15, 40, 100, 144):
            at = len(raw) - back
            other = raw[:at] + bytes([raw[at] ^ 31]) + raw[at + 1 :]
            assert not np.array_equal(mel, media.analyse(media.wav(other))[0]), (units, back)


def test_features_are_steps_that_noise_in_the_last_bits_does_not_move(monkeypatch, texts):
    files = [media.wav(media.padded(t.encode())) for t in list(texts.values())[:60]]
    found = [media.analyse(f) for f in files]
    assert all(np.array_equal(mel * media.STEPS, np.round(mel * media.STEPS)) for mel, _ in found)
    plain, rng = media.resample, np.random.default_rng(0)
    monkeypatch.setattr(media, "resample", lambda x: plain(x) * (1 + 1e-14 * rng.standard_normal(-(-len(x) * media.UP // media.DOWN))))
    for (mel, spans), f in zip(found, files, strict=True):
        again = media.analyse(f)
        assert np.array_equal(mel, again[0]) and spans == again[1]
