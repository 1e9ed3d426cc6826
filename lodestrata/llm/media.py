"""Telephony audio: mu-law, A-law and IMA ADPCM into 16-bit PCM, resampled, in WAV containers.

mu-law and A-law expand by tables of 256 samples. ADPCM decodes step by step within a block and
across all blocks of all files of a batch at once.

store() keeps a text's padded bytes as the samples of a mu-law or A-law file or as the blocks of an ADPCM file; any
bytes are such, so nothing is lost. The codec follows from the bytes, so equal texts give equal files. The files are
written to a table and read back from it; what they hold is expanded, resampled to 16 kHz and put into PCM files,
from which the features are taken.

Defined results: a null payload counts as empty. Empty audio gives empty PCM. A file that isn't a
RIFF/WAVE container of a known codec raises ValueError. Rows keep their repeats; other
columns are left out of the result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .base import BLOCK_BYTES, blocks, documents, lean, written

#: WAVE format tags.
FORMATS = {"pcm": 1, "alaw": 6, "mulaw": 7, "ima": 0x11}
#: What store() chooses from, bytes of an ADPCM block and of the padding's unit, samples a second stored and as PCM.
CODECS = ["mulaw", "alaw", "ima"]
UNIT = 64
RATE, PCM_RATE = 8000, 16000
#: IMA ADPCM: how the step index moves for a code's three low bits.
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
#: IMA ADPCM: the 89 step sizes of the format.
IMA_STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 255
    size = ((((code & 15) << 3) + 0x84) << (code >> 4 & 7)) - 0x84
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    shift, low = code >> 4 & 7, (code & 15) << 4
    size = np.where(shift == 0, low + 8, (low + 0x108) << np.maximum(shift - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()


def wav(codec: str, data: bytes, rate: int = 8000, block: int = 1) -> bytes:
    """A mono RIFF/WAVE file that holds data as it is; block: bytes of an ADPCM block."""
    bits = {"pcm": 16, "ima": 4}.get(codec, 8)
    align = {"pcm": 2, "ima": block}.get(codec, 1)
    extra = struct.pack("<HH", 2, (block - 4) * 2 + 1) if codec == "ima" else b"" if codec == "pcm" else struct.pack("<H", 0)
    per_second = rate * align // ((block - 4) * 2 + 1) if codec == "ima" else rate * align
    form = struct.pack("<HHIIHH", FORMATS[codec], 1, rate, per_second, align, bits) + extra
    fact = b"" if codec == "pcm" else b"fact" + struct.pack("<II", 4, len(data) // align * ((block - 4) * 2 + 1) if codec == "ima" else len(data))
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwav(file: bytes) -> tuple[str, int, int, bytes]:
    """Codec, rate, bytes of a block, and the stored bytes."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, codec, rate, block = 12, "", 0, 1
    while at + 8 <= len(file):
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"fmt ":
            tag, channels, rate, _, block = struct.unpack_from("<HHIIH", file, at + 8)
            codec = {v: k for k, v in FORMATS.items()}.get(tag, "")
            if not codec or channels != 1:
                raise ValueError(f"format {tag} with {channels} channels isn't known here")
        elif name == b"data":
            return codec, rate, block, file[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data in this file")


def ima_decode(data: bytes, block: int) -> np.ndarray:
    """All whole blocks of mono IMA ADPCM, decoded side by side."""
    n = len(data) // block
    raw = np.frombuffer(data, np.uint8, n * block).reshape(n, block)
    value = raw[:, :2].copy().view("<i2")[:, 0].astype(np.int32) if n else np.zeros(0, np.int32)
    index = np.minimum(raw[:, 2].astype(np.int32), 88)
    codes = np.stack([raw[:, 4:] & 15, raw[:, 4:] >> 4], axis=2).reshape(n, -1).astype(np.int32)
    out = np.empty((n, codes.shape[1] + 1), np.int16)
    out[:, 0] = value
    for i in range(codes.shape[1]):
        code, step = codes[:, i], IMA_STEPS[index]
        diff = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
        value = np.clip(value + np.where(code & 8, -diff, diff), -32768, 32767)
        index = np.clip(index + IMA_MOVES[code & 7], 0, 88)
        out[:, i + 1] = value
    return out.ravel()


def ima_encode(pcm: np.ndarray, block: int) -> bytes:
    """PCM as IMA ADPCM, blocks side by side; the last block is filled up with its last sample."""
    per = (block - 4) * 2 + 1
    n = -(-len(pcm) // per)
    x = np.append(pcm, np.full(n * per - len(pcm), pcm[-1] if len(pcm) else 0, np.int16)).reshape(n, per).astype(np.int32)
    value, index = x[:, 0].copy(), np.zeros(n, np.int32)
    out = np.zeros((n, block), np.uint8)
    out[:, :2] = x[:, :1].astype("<i2").view(np.uint8).reshape(n, 2) if n else 0
    for i in range(per - 1):
        step, gap = IMA_STEPS[index], x[:, i + 1] - value
        rest, code, diff = np.abs(gap), np.where(gap < 0, 8, 0), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            hit = rest >= part
            code, rest, diff = code + bit * hit, rest - part * hit, diff + part * hit
        value = np.clip(value + np.where(code & 8, -diff, diff), -32768, 32767)
        index = np.clip(index + IMA_MOVES[code & 7], 0, 88)
        out[:, 4 + i // 2] |= (code << (4 * (i & 1))).astype(np.uint8)
    return out.tobytes()


def expand(codec: str, data: bytes, block: int = 1) -> np.ndarray:
    """Stored bytes as 16-bit samples."""
    if codec == "ima":
        return ima_decode(data, block)
    if codec == "pcm":
        return np.frombuffer(data, "<i2", len(data) // 2).astype(np.int16)
    return {"mulaw": MULAW, "alaw": ALAW}[codec][np.frombuffer(data, np.uint8)]


def resample(pcm: np.ndarray, rate: int, to: int, taps: int = 8) -> np.ndarray:
    """A windowed sinc at each output sample's place; the filter of each phase is applied to all its outputs at once."""
    g = int(np.gcd(rate, to))
    up, down = to // g, rate // g
    n = -(-len(pcm) * up // down)
    if up == down or not n:
        return pcm.copy()
    x = np.concatenate([np.zeros(taps, np.float32), pcm.astype(np.float32), np.zeros(taps + 1, np.float32)])
    out, cut = np.empty(n, np.float32), min(1.0, up / down)
    for phase in range(min(up, n)):
        at = np.arange(phase, n, up, dtype=np.int64) * down
        whole, part = at // up, (at[0] % up) / up
        where = np.arange(1 - taps, taps + 1) - part
        window = np.sinc(where * cut) * np.cos(np.pi * where / (2 * taps + 2)) ** 2
        window /= window.sum()
        y = np.zeros(len(at), np.float32)
        for k, f in enumerate(window.astype(np.float32)):
            if abs(f) > 1e-7:
                y += f * x[whole + k + 1]
        out[phase::up] = y
    return np.clip(np.rint(out), -32768, 32767).astype(np.int16)


def expanded(files: list[bytes]) -> list[tuple[str, int, bytes, np.ndarray]]:
    """Codec, rate, stored bytes and samples of each file; ADPCM blocks of one size are decoded side by side, whatever file they are of."""
    read = [unwav(f) for f in files]
    own: list[np.ndarray | None] = [None if codec == "ima" else expand(codec, data, block) for codec, _, block, data in read]
    for size in {block for codec, _, block, _ in read if codec == "ima"}:
        at = [i for i, (codec, _, block, _) in enumerate(read) if codec == "ima" and block == size]
        many = np.array([len(read[i][3]) // size for i in at])
        both = ima_decode(b"".join(read[i][3][: n * size] for i, n in zip(at, many, strict=True)), size)
        edges = np.append(0, np.cumsum(many)) * ((size - 4) * 2 + 1)
        for k, i in enumerate(at):
            own[i] = both[edges[k] : edges[k + 1]]
    return [(codec, rate, data, x) for (codec, rate, _, data), x in zip(read, own, strict=True)]


def pcm_files(files: list[bytes], rate: int = PCM_RATE) -> list[tuple[str, bytes, bytes]]:
    """Codec, stored bytes, and the PCM WAV file at `rate` of each file."""
    return [(codec, data, wav("pcm", resample(x, own, rate).astype("<i2").tobytes(), rate)) for codec, own, data, x in expanded(files)]


def to_pcm(df: DataFrame, media: str = "media", key: str = "doc_id", rate: int = PCM_RATE) -> DataFrame:
    """key, samples, and `pcm`: each stored WAV file decoded, resampled to rate and stored as a PCM WAV file; a null file gives an empty one."""

    def run(batches):
        for t in blocks(batches, text=media):
            empty = wav("mulaw", b"", rate)
            out = [x[2] for x in pcm_files([x or empty for x in t.column(1).combine_chunks().to_pylist()], rate)]
            yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks(), pa.array([len(unwav(x)[3]) // 2 for x in out], pa.int64()), pa.array(out, pa.binary())], [key, "samples", "pcm"])

    return df.select(key, media).mapInArrow(lean(run), f"`{key}` {df.schema[key].dataType.simpleString()}, samples long, pcm binary")


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % UNIT or UNIT * (not text))


def stored(payload: bytes) -> bytes:
    """The payload as a WAV file; its codec follows from its checksum."""
    codec = CODECS[zlib.crc32(payload) % len(CODECS)]
    return wav(codec, payload, RATE, UNIT)


def features(codec: str, pcm: bytes) -> str:
    """Of a PCM file: codec, samples, peak, root mean square, sign changes, and the CRC-32 of the samples."""
    _, rate, _, raw = unwav(pcm)
    x = np.frombuffer(raw, "<i2")
    sign = x < 0
    peak = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    rms = int(np.sqrt(np.dot(x.astype(np.float32), x.astype(np.float32)) / max(len(x), 1)))
    return f"{codec}/{RATE};pcm={rate};n={len(x)};peak={peak};rms={rms};turns={int(np.count_nonzero(sign[1:] != sign[:-1]))};crc={zlib.crc32(raw):08x}"


def store(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes and `media`: the padded bytes of each text as a telephony WAV file, without loss."""

    def run(batches):
        for t in blocks(batches, text=text):
            texts = [x or b"" for x in t.column(1).combine_chunks().cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks(), pa.array(map(len, texts), pa.int64()), pa.array((stored(payload_of(x)) for x in texts), pa.binary())], [key, "n_bytes", "media"])

    return df.select(key, text).mapInArrow(lean(run), f"`{key}` {df.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def read_back(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests and features from the stored files alone."""

    def run(batches):
        for t in blocks(batches, text="media", limit=BLOCK_BYTES // 2):
            held = t.column(2).combine_chunks().to_pylist()
            cols: list[list] = [[] for _ in range(6)]
            for file, (codec, data, pcm) in zip(held, pcm_files(held), strict=True):
                for c, v in zip(cols, (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), features(codec, pcm)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks(), t.column(1).combine_chunks(), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())], [key, *OUT])

    return files.mapInArrow(lean(run), f"`{key}` {files.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


OUT = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of all texts, written to a table, and what is read back from it."""
    return read_back(written(store(documents(spark, sf_dir))))
