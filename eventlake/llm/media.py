"""Media columns: audio features of 8-bit samples (operator 7).

A payload of bytes is stored losslessly as the samples of a mono 8-bit WAV file. From the stored file: polyphase resampling,
overlapped log-mel filterbanks, hysteresis segmentation by energy. Log-mel frames are stored as a fixed-shape Arrow tensor
column (an IPC stream; patches of PATCH frames by MELS bands, the last filled up with the floor) beside each patch's time span.

Nulls and ties: a null payload is empty; an empty payload is one unit of padding. Equal payloads get equal results. A payload
of any length is read in blocks. No rows: no rows out. Other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import slices

#: Payloads are filled up to a multiple of UNIT bytes with FILL.
UNIT, FILL = 576, 255
RATE, UP, DOWN, TAPS = 16_000, 2, 5, 16
WINDOW, HOP, FFT, MELS, PATCH = 200, 80, 256, 20, 32
FLOOR = -10.0
#: Steps of features in one unit. They are computed in double precision, so that what processors add in another order, which
#: differs in the last bits, is rounded to the same step.
STEPS = 1024
#: Energy in standard deviations from its mean at which a segment begins, and at which it ends.
BEGIN, END = 0.5, -0.5
HEADER = 44
#: Frames that are transformed at once.
BLOCK = 8192


def padded(raw: bytes, unit: int = UNIT, fill: int = FILL) -> bytes:
    return raw + bytes([fill]) * (-len(raw) % unit if raw else unit)


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono 8-bit PCM file."""
    chunk = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8) + struct.pack("<4sI", b"data", len(samples))
    return struct.pack("<4sI4s", b"RIFF", 4 + len(chunk) + len(samples), b"WAVE") + chunk + samples


def read_wav(file: bytes) -> tuple[int, memoryview]:
    """Rate and samples of a mono 8-bit PCM file."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(file):
        name, size = struct.unpack_from("<4sI", file, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", file, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        elif name == b"data":
            return rate, memoryview(file)[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def lowpass(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """A windowed sinc, as one row of taps for each of ``up`` phases."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hamming(n)
    return (h / h.sum() * up).reshape(taps, up).T[:, ::-1]


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """x at up / down times its rate: output n takes phase (n * down) % up of the filter at input n * down // up."""
    phases, n_out = lowpass(up, down, taps), -(-len(x) * up // down)
    views = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(taps - 1), x]), taps)
    out = np.empty(n_out)
    for first in range(min(up, n_out)):
        at = first * down // up
        out[first::up] = views[at::down][: len(out[first::up])] @ phases[first * down % up]
    return out


def mel_bank(rate: float, bands: int = MELS, fft: int = FFT) -> np.ndarray:
    """Triangular filters, evenly spaced in mel; fft // 2 + 1 by bands."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, bands + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, fft // 2 + 1)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down))


_HANN = np.hanning(WINDOW)
_BANK = mel_bank(RATE * UP / DOWN)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames and their log energies; a signal is filled up with silence to a whole last frame."""
    more = WINDOW - len(x) if len(x) < WINDOW else (WINDOW - len(x)) % HOP
    x = np.concatenate([x, np.zeros(more)])
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    mel, energy = np.empty((len(frames), MELS), np.float32), np.empty(len(frames))
    for at in range(0, len(frames), BLOCK):
        part = frames[at : at + BLOCK]
        power = np.abs(np.fft.rfft(part * _HANN, FFT, axis=1)) ** 2
        mel[at : at + BLOCK] = np.round(np.maximum(FLOOR, np.log(power @ _BANK + 1e-6)) * STEPS) / STEPS
        energy[at : at + BLOCK] = np.round(np.log((part * part).mean(axis=1) + 1e-6) * STEPS) / STEPS
    return mel, energy


def segments(energy: np.ndarray, begin: float = BEGIN, end: float = END) -> list[tuple[int, int]]:
    """(first frame, end) of loud parts: on above ``begin``, off below ``end``, unchanged between."""
    level = np.round((energy - energy.mean()) / (energy.std() + 1e-6), 6)
    mark = np.where(level > begin, 1, np.where(level < end, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.r_[False, np.where(last >= 0, mark[last] > 0, False), False]
    turns = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))


def patches(mel: np.ndarray) -> pa.RecordBatch:
    """start_ms, end_ms and the tensor of each patch of frames."""
    n = -(-len(mel) // PATCH)
    full = np.full((n * PATCH, MELS), FLOOR, np.float32)
    full[: len(mel)] = mel
    ms = 1000 * HOP * DOWN / (RATE * UP)
    start = np.arange(n) * PATCH * ms
    end = np.minimum((np.arange(n) + 1) * PATCH, len(mel)) * ms
    tensor = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, PATCH, MELS))
    return pa.RecordBatch.from_arrays([pa.array(start), pa.array(end), tensor], names=["start_ms", "end_ms", "log_mel"])


def to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def analyse(file: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Log-mel frames and segments of a stored file."""
    _, samples = read_wav(file)
    x = (np.frombuffer(samples, np.uint8).astype(float) - 128) / 128
    # the filter's delay, so that the last samples come out, and a hop of silence, so that they don't stand where windows fade out
    mel, energy = log_mel(resample(np.concatenate([x, np.zeros(TAPS - 1 + -(-HOP * DOWN // UP))])))
    return mel, segments(energy)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (the WAV file), tensors (Arrow IPC), n_frames, segments (spans in ms) of every row.

    What the features are computed from are the samples read back from ``media``.
    """
    df = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    span = pa.list_(pa.struct([("start_ms", pa.float64()), ("end_ms", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ms = 1000 * HOP * DOWN / (RATE * UP)
        for batch in slices(batches):
            sizes, media, tensors, frames, spans = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                raw = (text or "").encode()
                file = wav(padded(raw))
                mel, found = analyse(file)
                sizes.append(len(raw))
                media.append(file)
                tensors.append(to_ipc(patches(mel)))
                frames.append(len(mel))
                spans.append([{"start_ms": a * ms, "end_ms": b * ms} for a, b in found])
            arrays = [pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(tensors, pa.binary()), pa.array(frames, pa.int64()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", "n_bytes", "media", "tensors", "n_frames", "segments"])

    schema = "n_bytes long, media binary, tensors binary, n_frames long, segments array<struct<start_ms:double,end_ms:double>>"
    return df.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, {schema}")


def digests(encoded: DataFrame) -> DataFrame:
    """Checksums of the stored bytes and of the payload that is read back from them, and a line on the features."""
    payload = F.expr(f"substring(media, {HEADER + 1}, octet_length(media) - {HEADER})")
    loud = F.expr("aggregate(segments, 0D, (a, s) -> a + s.end_ms - s.start_ms)")
    out = encoded.withColumn("payload", payload)
    return out.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, octet_length(payload) - 31, 32)")).cast("long").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.format_string("log_mel:%d,segments:%d,loud_ms:%.0f,sha256:%s", "n_frames", F.size("segments"), loud, F.sha2("tensors", 256)).alias("feature"),
    )
