"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAVE containers (operator 8).

A payload of 8-bit units is stored as the data chunk of a WAVE file, read back from the stored bytes, expanded to
linear samples (mu-law and A-law by a table of 256 entries, ADPCM by stepping through all blocks of a slice side by
side in numpy), resampled from 8 to 16 kHz and described.

Defined cases: a null or empty text becomes one unit of padding; equal payloads get the same codec, bytes and feature;
a clipped ADPCM step index is the only liberty taken with arbitrary bytes, and it leaves the stored bytes untouched.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, utf8, written

UNIT = 576
#: Samples on each side of a filtered value.
HALF_TAPS = 8
PAD = 255
RATE = 8000
SLICE_BYTES = 1_000_000
#: WAVE format tags.
TAGS = {"alaw": 6, "ulaw": 7, "adpcm": 17}
CODECS = ("ulaw", "alaw", "adpcm")
#: IMA step index changes by the low three bits of a nibble.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
#: IMA step sizes.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)


def ulaw_table() -> np.ndarray:
    """Linear value of each mu-law byte: inverted bits, sign, three bits of exponent, four of mantissa, bias 132."""
    u = ~np.arange(256, dtype=np.int32) & 255
    size = (((u & 15) << 3) + 132 << (u >> 4 & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear value of each A-law byte: even bits inverted; a set sign bit is positive."""
    a = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, step = a >> 4 & 7, (a & 15) << 4
    size = np.where(exponent == 0, step + 8, step + 264 << np.maximum(exponent - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


TABLES = {"ulaw": ulaw_table(), "alaw": alaw_table()}


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM blocks (rows of bytes): a 16-bit first sample, a step index, then nibbles, low ones first."""
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    data = blocks[:, 4:].T
    out = np.empty((1 + 2 * len(data), len(blocks)), np.int16)
    out[0] = value
    for i, byte in enumerate(data):
        for k in (0, 1):
            nibble = (byte >> 4 * k & 15).astype(np.int32)
            step = STEPS[index]
            change = (step >> 3) + (step * (nibble & 1) >> 2) + (step * (nibble >> 1 & 1) >> 1) + step * (nibble >> 2 & 1)
            value = np.clip(value + np.where(nibble & 8, -change, change), -32768, 32767)
            index = np.clip(index + INDEX_STEP[nibble & 7], 0, len(STEPS) - 1)
            out[1 + 2 * i + k] = value
    return out.T


def wave(payload: bytes, codec: str) -> bytes:
    """A WAVE file, mono at 8 kHz, whose data chunk is the payload."""
    if codec == "adpcm":
        form = struct.pack("<HHIIHHHH", TAGS[codec], 1, RATE, RATE * UNIT // (2 * (UNIT - 4) + 1), UNIT, 4, 2, 2 * (UNIT - 4) + 1)
    else:
        form = struct.pack("<HHIIHHH", TAGS[codec], 1, RATE, RATE, 1, 8, 0)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwave(media: bytes) -> tuple[str, bytes]:
    """Codec and data chunk of a stored file, found by walking its chunks."""
    at, tag, data = 12, 0, b""
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    return next(c for c, t in TAGS.items() if t == tag), data


def half_band(reach: int = HALF_TAPS) -> np.ndarray:
    """Weights, in 1/32768, of the samples before and after the middle between two: a sinc under a Hamming window."""
    at = np.arange(reach) + 0.5
    weights = np.sinc(at) * (0.54 + 0.46 * np.cos(np.pi * at / reach))
    whole = np.round(weights / (2 * weights.sum()) * 32768).astype(np.int64)
    whole[0] += (32768 - 2 * int(whole.sum())) // 2
    return np.concatenate([whole[::-1], whole])


def resampled(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate by a two-phase low-pass filter: each sample, and between it and the next the filtered value.

    Before the first and after the last sample stand copies of them.  All arithmetic is on integers.
    """
    weights = half_band()
    reach = len(weights) // 2
    wide = np.concatenate([np.full(reach - 1, pcm[0]), pcm, np.full(reach, pcm[-1])]).astype(np.int64)
    between = np.zeros(len(pcm), np.int64)
    for i, w in enumerate(weights.tolist()):
        between += w * wide[i : i + len(pcm)]
    out = np.empty(2 * len(pcm), "<i2")
    out[::2] = pcm
    out[1::2] = np.clip(between + 16384 >> 15, -32768, 32767)
    return out


def feature(codec: str, pcm: np.ndarray) -> str:
    wide = pcm.astype(np.int64)
    power = int((wide * wide).sum())
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{codec};rate={2 * RATE};samples={len(pcm)};peak={int(np.abs(wide).max())};power={power};crossings={crossings};pcm_crc32={zlib.crc32(pcm.tobytes())}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", codecs: tuple[str, ...] = CODECS) -> DataFrame:
    """(id, n_bytes, media): each text as a WAVE file; the codec follows from the payload alone."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in text_slices(offsets, SLICE_BYTES):
                media = []
                for i in range(a, b):
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    raw += bytes([PAD]) * (-len(raw) % UNIT if raw else UNIT)
                    media.append(wave(raw, codecs[zlib.crc32(raw) % len(codecs)]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets[a : b + 1])), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def linear(parts: list[tuple[str, bytes]]) -> list[np.ndarray]:
    """Samples of each (codec, data); the ADPCM blocks of all of them are decoded together."""
    blocks = [np.frombuffer(d, np.uint8).reshape(-1, UNIT) for c, d in parts if c == "adpcm"]
    pcm = iter(np.split(adpcm(np.concatenate(blocks)), np.cumsum([len(x) for x in blocks])[:-1])) if blocks else iter(())
    return [next(pcm).ravel() if c == "adpcm" else TABLES[c][np.frombuffer(d, np.uint8)] for c, d in parts]


def decode(media: DataFrame, id_col: str = "doc_id", keep_pcm: bool = True) -> DataFrame:
    """What the stored bytes hold: payload facts, a feature, and (keep_pcm) the 16 kHz samples as little-endian 16-bit PCM."""
    kind = media.schema[id_col].dataType.simpleString()
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["pcm"] * keep_pcm
    types = [kind, "long", "long", "string", "long", "long", "string", "string"] + ["binary"] * keep_pcm

    def run(batches):
        for batch in batches:
            stored = batch.column(2)
            sizes = np.concatenate([[0], np.cumsum([len(x.as_buffer()) for x in stored])])
            for a, b in text_slices(sizes, SLICE_BYTES):
                files = stored.slice(a, b - a).to_pylist()
                parts = [unwave(m) for m in files]
                pcm = [resampled(x) for x in linear(parts)]
                columns = [
                    batch.column(0).slice(a, b - a),
                    batch.column(1).slice(a, b - a),
                    pa.array([len(d) for _, d in parts], pa.int64()),
                    pa.array([hashlib.sha256(d).hexdigest() for _, d in parts]),
                    pa.array([zlib.crc32(d[-32:]) for _, d in parts], pa.int64()),
                    pa.array([len(m) for m in files], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in files]),
                    pa.array([feature(c, x) for (c, _), x in zip(parts, pcm)]),
                ]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array([x.tobytes() for x in pcm], pa.binary())] if keep_pcm else []), names)

    return media.select(F.col(id_col).alias("id"), "n_bytes", "media").mapInArrow(run, ", ".join(map(" ".join, zip(names, types)))).withColumnRenamed("id", id_col)


def stored_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_pcm: bool = True) -> DataFrame:
    """Texts as a written table of WAVE files, read back, described and resampled.

    The samples (pcm) are 4 to 8 times the text, beyond what may lie on disk beside the input and the result, so they
    are stored with the result and not in a table before it.
    """
    return decode(written(store(docs, id_col, text_col), "telephony-media"), id_col, keep_pcm)
