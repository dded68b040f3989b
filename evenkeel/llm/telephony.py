"""Telephony audio columns: companded 8-bit samples, ADPCM blocks and resampled PCM.

A text's UTF-8 bytes are taken as companded samples.  They are padded with zero bytes
to a positive multiple of 64 and stored, unchanged, in a WAVE container whose format
is 8-bit mu-law at 8 kHz; the stored bytes are then parsed again and everything else
is computed from what was read back:

* mu-law and A-law expansion by 256-entry lookup tables;
* IMA ADPCM, each 64 bytes being one block (4 header bytes, 120 nibbles), decoded
  with numpy across all blocks of a slice: one step per nibble position;
* the mu-law PCM resampled to 16 kHz by linear interpolation, as a 16-bit WAVE.

Defined results: a null text counts as empty and becomes 64 zero bytes; ids may be
null or repeated (each row stands for itself); an empty table gives an empty table;
other columns of the input are ignored.  Equal texts give equal values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan

BLOCK = 64
RATE = 8000

# The step sizes and index changes of IMA ADPCM.
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
    118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
    1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
    6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
    32767,
)
INDEX_CHANGES = (-1, -1, -1, -1, 2, 4, 6, 8)


def mulaw_table() -> np.ndarray:
    """PCM of each mu-law code (G.711): complemented sign, exponent and mantissa, bias 132."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM of each A-law code (G.711): every other bit inverted, sign bit set for positive."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def _adpcm_moves() -> tuple[np.ndarray, np.ndarray]:
    """For each (index, nibble): the change of the predictor and the next index."""
    step = np.array(STEPS, np.int32)[:, None]
    nibble = np.arange(16, dtype=np.int32)[None, :]
    change = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    change = np.where(nibble & 8, -change, change)
    index = np.arange(len(STEPS))[:, None] + np.array(INDEX_CHANGES)[nibble & 7]
    return change.astype(np.int32).ravel(), np.clip(index, 0, len(STEPS) - 1).astype(np.int32).ravel()


MULAW, ALAW = mulaw_table(), alaw_table()
_CHANGE, _NEXT = _adpcm_moves()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, 64) bytes of IMA ADPCM blocks to (n, 121) samples; an index over 88 counts as 88."""
    n = len(blocks)
    columns = np.ascontiguousarray(blocks.T)
    predictor = (columns[0].astype(np.int32) | (columns[1].astype(np.int32) << 8)).astype(np.int16).astype(np.int32)
    index = np.minimum(columns[2], len(STEPS) - 1).astype(np.int32)
    out = np.empty((2 * (BLOCK - 4) + 1, n), np.int16)
    out[0] = predictor
    at = 1
    for column in columns[4:]:
        for nibble in (column & 15, column >> 4):
            key = (index << 4) + nibble
            predictor = predictor + _CHANGE[key]
            np.clip(predictor, -32768, 32767, out=predictor)
            index = _NEXT[key]
            out[at] = predictor
            at += 1
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Twice the rate by linear interpolation; a signal's last sample is held."""
    following = np.empty_like(pcm)
    following[:-1] = pcm[1:]
    following[ends - 1] = pcm[ends - 1]
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1::2] = (pcm.astype(np.int32) + following) >> 1
    return out


def wave(tag: int, bits: int, rate: int, samples: bytes) -> bytes:
    """A mono WAVE file; formats other than PCM carry a fact chunk."""
    width = bits // 8
    fmt = struct.pack("<HHIIHH", tag, 1, rate, rate * width, width, bits)
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt
    if tag != 1:
        chunks += b"fact" + struct.pack("<II", 4, len(samples) // width)
    chunks += b"data" + struct.pack("<I", len(samples))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks) + len(samples)) + b"WAVE" + chunks + samples


def samples_of(media: bytes) -> memoryview:
    """The data chunk of a WAVE file."""
    view, at = memoryview(media), 12
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a WAVE file")
    while at + 8 <= len(view):
        size = int.from_bytes(view[at + 4 : at + 8], "little")
        if view[at : at + 4] == b"data":
            return view[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def payload(text: bytes) -> bytes:
    """The bytes padded with zeros to a positive multiple of 64."""
    return text + bytes(-len(text) % BLOCK if text else BLOCK)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in bytescan.slices(batch, "text"):
            texts = bytescan.as_binary(part.column("text")).to_pylist()
            media = [wave(7, 8, RATE, payload(x)) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"]
            )


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's payload as a stored 8-bit mu-law WAVE."""
    rows = df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    return rows.mapInArrow(_store, "id long, n_bytes long, media binary")


def _features(keep_pcm: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytescan.slices(batch, "media"):
                media = part.column("media").to_pylist()
                stored = [samples_of(x) for x in media]
                ends = np.cumsum([len(x) for x in stored])
                starts = ends - [len(x) for x in stored]
                data = np.frombuffer(b"".join(stored), np.uint8)
                pcm, other = MULAW[data], ALAW[data]
                adpcm = decode_adpcm(data.reshape(-1, BLOCK))
                wide = resample(pcm, ends)
                counts = (ends - starts).astype(np.float64)
                rms = np.sqrt(np.add.reduceat(pcm.astype(np.int64) ** 2, starts) / counts)
                rms_a = np.sqrt(np.add.reduceat(other.astype(np.int64) ** 2, starts) / counts)
                peak = np.maximum.reduceat(np.abs(pcm.astype(np.int32)), starts)
                turns = np.zeros(len(pcm), np.int64)
                turns[1:] = (pcm[1:] < 0) != (pcm[:-1] < 0)
                turns[starts] = 0
                crossings = np.add.reduceat(turns, starts)
                rows = []
                for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                    own = stored[i]
                    pcm_crc = zlib.crc32(wide[2 * a : 2 * b])
                    adpcm_crc = zlib.crc32(adpcm[a // BLOCK : b // BLOCK])
                    rows.append((
                        b - a, hashlib.sha256(own).hexdigest(), zlib.crc32(own[-BLOCK:]), len(media[i]), hashlib.sha256(media[i]).hexdigest(),
                        f"ulaw8k rms={rms[i]:.3f} peak={peak[i]} zc={crossings[i]} alaw_rms={rms_a[i]:.3f} adpcm={adpcm_crc:08x} pcm16k={pcm_crc:08x}",
                        wave(1, 16, 2 * RATE, wide[2 * a : 2 * b].tobytes()) if keep_pcm else None,
                    ))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()][: 6 + keep_pcm]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"][: 6 + keep_pcm]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), *columns], ["id", "n_bytes", *names])

    return run


def media_features(media: DataFrame, keep_pcm: bool = False) -> DataFrame:
    """Read stored media back: digests and features, and with ``keep_pcm`` the 16 kHz PCM WAVE."""
    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("id", "n_bytes", "media").mapInArrow(_features(keep_pcm), schema + (", pcm binary" if keep_pcm else ""))


def telephony_digest(docs: DataFrame) -> DataFrame:
    """One row per document: store, read back, resample; digests of the stored bytes and of the PCM file."""
    out = media_features(store_media(docs), keep_pcm=True)
    pcm = [F.octet_length("pcm").cast("long").alias("pcm_bytes"), F.sha2("pcm", 256).alias("pcm_sha256")]
    return out.select(F.col("id").alias("doc_id"), *[c for c in out.columns if c not in ("id", "pcm")], *pcm)
