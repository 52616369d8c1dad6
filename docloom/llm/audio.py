"""Audio columns: polyphase resampling, overlapped log-mel filterbanks, hysteresis segments.

:func:`store` turns texts into media: their UTF-8 bytes, filled up with 255 to a
positive multiple of 576, are the samples of an 8-bit mono WAVE file. Nothing is
lost, so the bytes can be read back. :func:`features` reads media: samples are
resampled by 3/4 with a windowed-sinc filter split into its phases, cut into
frames that overlap by half, and each frame becomes the logarithm of its
energy in mel bands. Frame energies above an upper threshold open a segment,
which lasts until they fall below a lower one.

The bands of 64 frames at a time make one tensor of fixed shape. A document's
tensors and their time spans are an Arrow stream with a fixed-shape tensor
column (:func:`tensors` reads it). Values are multiples of 1/64, and frames are
computed in groups counted from the start of the document, so equal media give
equal bytes.

Defined cases: a null text counts as empty, which gives 576 bytes of 255; media
that are null have null features; an energy that equals a threshold changes nothing; repeated rows give equal results; very
long clips are computed in groups of frames; an empty table gives no rows; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import io
import math
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.bpe import text_blocks
from docloom.llm.common import on_workers

UNIT = 576
FILL = 255
RATE = 8000
UP, DOWN, TAPS = 3, 4, 16
FRAME, HOP, FFT, BANDS, ROWS = 192, 96, 256, 32, 64
#: Frames that are computed at once.
GROUP = 2048
OUT_RATE = RATE * UP // DOWN


def payload_of(raw: bytes) -> bytes:
    return raw + bytes([FILL]) * (-len(raw) % UNIT if raw else UNIT)


def wave(payload: bytes) -> bytes:
    """An 8-bit mono WAVE file with ``payload`` as its samples."""
    fmt = struct.pack("<HHIIHH", 1, 1, RATE, RATE, 1, 8)
    odd = len(payload) & 1
    head = struct.pack("<4sI4s4sI", b"RIFF", 4 + 8 + len(fmt) + 8 + len(payload) + odd, b"WAVE", b"fmt ", len(fmt))
    return head + fmt + struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * odd


def samples(media: bytes) -> bytes:
    """The samples of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at = 12
    while at + 8 <= len(media):
        kind, n = struct.unpack_from("<4sI", media, at)
        if kind == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("a WAVE file without samples")


@lru_cache(1)
def _phases() -> np.ndarray:
    """Filter taps by phase of the output and distance of the input sample."""
    k = np.arange(1 - TAPS // 2, TAPS // 2 + 1)
    r = (np.arange(UP) * DOWN) % UP
    t = (r[:, None] - k[None, :] * UP) / UP  # in input samples
    cut = min(1.0, UP / DOWN)
    g = cut * np.sinc(cut * t) * np.where(np.abs(t) < TAPS / 2, 0.5 + 0.5 * np.cos(2 * np.pi * t / TAPS), 0.0)
    return (g / g.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(u8: np.ndarray, first: int, count: int) -> np.ndarray:
    """Output samples ``first`` (a multiple of ``UP``) to ``first + count`` of a clip; zero beyond its ends."""
    jobs = -(-count // UP)
    lo = first // UP * DOWN - TAPS // 2 + 1
    hi = lo + jobs * DOWN + TAPS + DOWN
    x = np.zeros(hi - lo, np.float32)
    a, b = max(lo, 0), min(hi, len(u8))
    if b > a:
        x[a - lo : b - lo] = (u8[a:b].astype(np.float32) - 128) / 128
    y = np.zeros((jobs, UP), np.float32)
    for r, taps in enumerate(_phases()):
        base = r * DOWN // UP
        for k, g in enumerate(taps):
            y[:, r] += g * x[base + k :: DOWN][:jobs]
    return y.reshape(-1)[:count]


@lru_cache(1)
def _mel() -> tuple[np.ndarray, np.ndarray]:
    """The window of a frame, and the weight of each bin in each band."""

    def mel(f):
        return 2595 * np.log10(1 + f / 700)

    edges = 700 * (10 ** (np.linspace(mel(60.0), mel(OUT_RATE / 2), BANDS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * OUT_RATE / FFT
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.hanning(FRAME).astype(np.float32), np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(u8: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bands of each frame, rounded to 1/64, and its energy in dB."""
    n_out = -(-len(u8) * UP // DOWN)
    n_frames = 1 + max(0, -(-(n_out - FRAME) // HOP))
    window, weights = _mel()
    bands, energy = np.empty((n_frames, BANDS), np.float32), np.empty(n_frames, np.float32)
    for f in range(0, n_frames, GROUP):
        n = min(GROUP, n_frames - f)
        y = resample(u8, f * HOP, (n - 1) * HOP + FRAME)
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * window
        power = np.abs(np.fft.rfft(frames, FFT, axis=1)).astype(np.float32) ** 2
        bands[f : f + n] = np.round(np.log(power @ weights + np.float32(1e-6)) * 64) / 64
        energy[f : f + n] = 10 * np.log10(np.einsum("ij,ij->i", frames, frames) / FRAME + 1e-9)
    return bands, energy


def segments(energy: np.ndarray, spread: float = 0.5) -> list[tuple[int, int]]:
    """Runs of frames ``[a, b)`` that open above the mean by ``spread`` deviations and end below it by as many."""
    e = np.round(energy.astype(np.float64), 3)
    mean, dev = e.mean(), e.std()
    if dev < 1e-6:
        return []
    state = np.where(e > mean + spread * dev, 1, np.where(e < mean - spread * dev, -1, 0))
    at = np.where(state != 0, np.arange(len(e)), -1)
    last = np.maximum.accumulate(at)
    on = np.r_[False, (last >= 0) & (state[np.maximum(last, 0)] == 1), False]
    edge = np.nonzero(on[1:] != on[:-1])[0]
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


TENSOR = pa.fixed_shape_tensor(pa.float32(), [ROWS, BANDS], dim_names=["frame", "band"])


def stream(bands: np.ndarray) -> bytes:
    """Tensors and their time spans, in seconds, as an Arrow stream."""
    n = -(-len(bands) // ROWS)
    full = np.full((n * ROWS, BANDS), np.log(np.float32(1e-6)), np.float32)
    full[: len(bands)] = bands
    start = np.arange(n) * ROWS * HOP / OUT_RATE
    end = ((np.minimum(np.arange(1, n + 1) * ROWS, len(bands)) - 1) * HOP + FRAME) / OUT_RATE
    tensor = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), ROWS * BANDS))
    out = pa.RecordBatch.from_arrays([pa.array(start), pa.array(end), tensor], names=["start_s", "end_s", "log_mel"])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, out.schema) as w:
        w.write_batch(out)
    return sink.getvalue()


def tensors(features: bytes) -> pa.Table:
    return pa.ipc.open_stream(features).read_all()


MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload binary, media binary, n_frames long, features binary, spans array<struct<start_s: double, end_s: double>>"
_SPANS = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))


def store(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media`` of each row of ``docs(doc_id, text)``."""
    on_workers(docs.sparkSession)

    def go(batches):
        for doc_id, texts in text_blocks(batches, 2 << 20):
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(map(len, raw), pa.int64()), pa.array([wave(payload_of(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(go, MEDIA)


def features(media: DataFrame) -> DataFrame:
    """For each row of ``media(doc_id, n_bytes, media)``: the samples read back, tensors, and spans of sound in seconds."""
    on_workers(media.sparkSession)
    names = [x.split()[0] for x in FEATURES.split(", ")][:7]

    def go(batches):
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                cols, size = ([], [], [], []), 0
                begin = at
                while at < batch.num_rows and size < 2 << 20:
                    x = batch.column(2)[at].as_py()
                    at += 1
                    if x is None:
                        for c in cols:
                            c.append(None)
                        continue
                    payload = samples(x)
                    size += len(payload)
                    bands, energy = log_mel(np.frombuffer(payload, np.uint8))
                    spans = [{"start_s": a * HOP / OUT_RATE, "end_s": ((b - 1) * HOP + FRAME) / OUT_RATE} for a, b in segments(energy)]
                    for c, v in zip(cols, (payload, len(bands), stream(bands), spans), strict=True):
                        c.append(v)
                part = batch.slice(begin, at - begin)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(cols[0], pa.binary()), part.column(2), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], _SPANS)],
                    names=names,
                )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(go, FEATURES)


def digests(found: DataFrame) -> DataFrame:
    return found.selectExpr(
        "doc_id",
        "n_bytes",
        "octet_length(payload) * 1L payload_bytes",
        "sha2(payload, 256) payload_sha256",
        "crc32(substring(payload, -32)) tail_crc32",
        "octet_length(media) * 1L media_bytes",
        "sha2(media, 256) media_sha256",
        "concat_ws(':', n_frames, size(spans), sha2(features, 256)) feature",
        "n_frames",
        "size(spans) * 1L n_spans",
    )
