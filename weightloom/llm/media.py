"""Media columns: audio features of byte payloads.

`store` writes each payload losslessly as 8-bit mono samples in a WAV container, as rows of Arrow files in the shared
folder. `featured` reads these files back and works from what it reads: polyphase resampling to half the rate, log-mel
energies of overlapped frames, and segments of sound by energy with two thresholds. Log-mels are cut into patches of a
fixed shape, (PATCH, MELS), the last padded with the floor, and written as Arrow fixed-shape tensors of half precision,
with time spans. `read_patches` and the digests take the tensors from these files.

Files have names of their own attempt; a manifest row names each one that counts, so a lost attempt leaves at most an
orphan. Files are closed at FILE_BYTES of payload. Samples are worked through in blocks that share their overlap, so a
very long payload needs memory in proportion to its bytes only. Null texts are empty payloads, padded to one unit of 64
bytes; null keys stay null. Equal texts give equal values; repeated rows are worked out alike; of equal energies none
counts as above the other. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import wave
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weightloom.llm.common import open_fs, shuffle_partitions, ship, slices, spread, work_dir

RATE, UNIT = 16_000, 64
FRAME, HOP, MELS, PATCH = 256, 128, 32, 16
#: Frames worked out at a time, and bytes of payload in a file.
BLOCK, FILE_BYTES = 4096, 32 << 20
#: Log energy from which a segment opens, and below which it closes, over the payload's median.
OPEN, CLOSE = 0.25, 0.1
FLOOR = -10.0
TENSOR = pa.fixed_shape_tensor(pa.float16(), (PATCH, MELS))
_MANIFEST = "name string, n_rows long, media_bytes long"


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % UNIT or (UNIT if not raw else 0))


def wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def load(media: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes()), w.getframerate()


@lru_cache(maxsize=8)
def low_pass(up: int, down: int, half: int = 8) -> np.ndarray:
    """Windowed-sinc filter for resampling by up/down, one row of taps per phase."""
    width = max(up, down)
    n = np.arange(-half * width, half * width + 1)
    taps = np.sinc(n / width) * np.hamming(len(n)) * (up / width)
    taps = np.concatenate([taps, np.zeros(-len(taps) % up)])
    return taps.reshape(-1, up).T.astype(np.float32)


def resample(x: np.ndarray, up: int = 1, down: int = 2) -> np.ndarray:
    """Polyphase resampling: each output sample uses only its own phase of the filter."""
    phases = low_pass(up, down)
    n_taps, n_out = phases.shape[1], -(-len(x) * up // down)
    delay = 8 * max(up, down)
    at = np.arange(n_out, dtype=np.int64) * down + delay
    phase, newest = at % up, at // up
    ext = np.concatenate([np.zeros(n_taps, np.float32), x, np.zeros(n_taps + delay + 1, np.float32)])
    out = np.empty(n_out, np.float32)
    for p in range(up):
        mine = np.flatnonzero(phase == p)
        for lo in range(0, len(mine), 1 << 16):
            rows = mine[lo : lo + (1 << 16)]
            total = np.zeros(len(rows), np.float32)
            for k in range(n_taps):
                total += phases[p, k] * ext[newest[rows] + n_taps - k]
            out[rows] = total
    return out


@lru_cache(maxsize=4)
def filterbank(rate: int) -> np.ndarray:
    """Triangles evenly spaced on the mel scale, as (bins, MELS)."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    rise, fall = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> np.ndarray:
    """(frames, MELS); the last frame is padded with zeros."""
    n = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    x = np.concatenate([x, np.zeros((n - 1) * HOP + FRAME - len(x), np.float32)])
    frames, window, bank = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP], np.hanning(FRAME).astype(np.float32), filterbank(rate)
    parts = [np.log10(np.abs(np.fft.rfft(frames[i : i + BLOCK] * window, axis=1)) ** 2 @ bank + 10**FLOOR) for i in range(0, n, BLOCK)]
    return np.concatenate(parts).astype(np.float32)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames that stay above CLOSE and reach OPEN, both over the median."""
    rel = energy - np.median(energy)
    above = np.concatenate([[0], (rel > CLOSE).astype(np.int8), [0]])
    starts, ends = np.flatnonzero(np.diff(above) == 1), np.flatnonzero(np.diff(above) == -1)
    peaks = np.concatenate([[0], np.cumsum(rel >= OPEN)])
    return [(int(a), int(b)) for a, b in zip(starts, ends, strict=True) if peaks[b] > peaks[a]]


def features(media: bytes) -> tuple[bytes, np.ndarray, list[tuple[float, float]], float]:
    """The stored payload, log-mels, segments in seconds and seconds per frame."""
    payload, rate = load(media)
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(x), rate // 2)
    step = HOP / (rate // 2)
    return payload, mel, [(a * step, b * step) for a, b in segments(mel.mean(1))], step


def patches(mel: np.ndarray) -> np.ndarray:
    """(patches, PATCH, MELS)."""
    short = -len(mel) % PATCH
    return np.concatenate([mel, np.full((short, MELS), FLOOR, np.float32)]).reshape(-1, PATCH, MELS)


class Files:
    """Arrow files of one attempt, begun when there is something to write; compressed, as payloads are."""

    def __init__(self, out: str, schema: pa.Schema):
        (self.fs, self.at), self.schema, self.sink = open_fs(out), schema, None

    def write(self, batch: pa.RecordBatch) -> None:
        if self.sink is None:
            self.fs.create_dir(self.at, recursive=True)
            self.name = f"{uuid.uuid4().hex}.arrow"
            self.file = self.fs.open_output_stream(f"{self.at}/{self.name}", compression=None)
            self.sink = pa.ipc.new_file(self.file, self.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1)))
        self.sink.write_batch(batch)

    def close(self) -> str:
        self.sink.close()
        self.file.close()
        self.sink = None
        return self.name


def batches_of(path: str) -> Iterator[pa.RecordBatch]:
    fs, at = open_fs(path)
    with fs.open_input_file(at) as f:
        found = pa.ipc.open_file(f)
        for i in range(found.num_record_batches):
            yield found.get_batch(i)


def store(df: DataFrame, out: str | None = None, key: str = "doc_id", text: str = "text") -> str:
    """Write every payload; returns the folder. Rows of its files: key, n_bytes, media (the WAV)."""
    spark = df.sparkSession
    ship(spark)
    out = out or work_dir(spark, "media")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, n, size = None, 0, 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([sink.close()]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["name", "n_rows", "media_bytes"])

        for whole in batches:
            sink = sink or Files(f"{out}/media", pa.schema([("key", whole.schema.field("key").type), ("n_bytes", pa.int64()), ("media", pa.binary())]))
            for b in slices(whole, limit=1 << 20):
                raws = [(t or "").encode() for t in b.column("text").to_pylist()]
                media = [wav(padded(raw)) for raw in raws]
                sink.write(pa.RecordBatch.from_arrays([b.column("key"), pa.array([len(x) for x in raws], pa.int64()), pa.array(media, pa.binary())], schema=sink.schema))
                n, size = n + len(media), size + sum(map(len, media))
                if size >= FILE_BYTES:
                    yield closed()
                    n = size = 0
        if n:
            yield closed()

    rows = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text")))
    rows.mapInArrow(run, _MANIFEST).write.parquet(f"{out}/manifest")
    return out


def featured(spark: SparkSession, out: str, key: str = "doc_id", kind: str = "long") -> DataFrame:
    """Work out the features of all files `store` wrote and write their tensors.

    Rows (key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, frames, patches, segments:
    [(start_s, end_s)], tensors: the file that has the patches, first_patch: their place there, tensor_sha256: of the
    patches as read back).
    """
    ship(spark)
    manifest = spark.read.schema(_MANIFEST).parquet(f"{out}/manifest").select("name")
    spans = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames", "patches", "segments", "tensors", "first_patch", "tensor_sha256"]
    longs = {"n_bytes", "payload_bytes", "tail_crc32", "media_bytes", "frames", "patches", "first_patch"}

    def of_file(name: str) -> Iterator[pa.RecordBatch]:
        sink, rows, key_type, patch = None, [], None, 0
        for b in batches_of(f"{out}/media/{name}"):
            key_type = b.schema.field("key").type
            sink = sink or Files(f"{out}/tensors", pa.schema([("key", key_type), ("patch", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("sound", pa.bool_()), ("log_mel", TENSOR)]))
            parts = []
            for k, n, media in zip(*(b.column(c).to_pylist() for c in ("key", "n_bytes", "media")), strict=True):
                payload, mel, found, step = features(media)
                cut = patches(mel)
                rows.append([k, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), len(mel), len(cut), [{"start_s": x, "end_s": y} for x, y in found], None, patch, None])
                patch += len(cut)
                parts.append((k, cut, found, step))
            keys = pa.array([k for k, cut, *_ in parts for _ in range(len(cut))], key_type)
            at = np.concatenate([np.arange(len(cut)) * PATCH * step for _, cut, _, step in parts])
            end = at + PATCH * parts[0][3]
            sound = [any(x < e and y > a for x, y in found) for _, cut, found, step in parts for a, e in ((i * PATCH * step, (i + 1) * PATCH * step) for i in range(len(cut)))]
            numbers = np.concatenate([np.arange(len(cut)) for _, cut, *_ in parts])
            tensor = pa.FixedShapeTensorArray.from_numpy_ndarray(np.concatenate([cut for _, cut, *_ in parts]).astype(np.float16))
            sink.write(pa.RecordBatch.from_arrays([keys, pa.array(numbers, pa.int64()), pa.array(at), pa.array(end), pa.array(sound, pa.bool_()), tensor], schema=sink.schema))
        if sink is None:
            return
        written, at, row = sink.close(), 0, 0
        rest, digest = 0, None
        for b in batches_of(f"{out}/tensors/{written}"):
            cut = b.column("log_mel").to_numpy_ndarray()
            lo = 0
            while lo < len(cut):
                if digest is None:
                    digest, rest = hashlib.sha256(), rows[row][8]
                take = min(rest, len(cut) - lo)
                digest.update(np.ascontiguousarray(cut[lo : lo + take]).tobytes())
                lo, rest = lo + take, rest - take
                if not rest:
                    rows[row][10], rows[row][12] = written, digest.hexdigest()
                    digest, row = None, row + 1
        kinds = [key_type if c == "key" else spans if c == "segments" else pa.int64() if c in longs else pa.string() for c in names]
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000], strict=True), kinds, strict=True)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("name").to_pylist():
                yield from of_file(name)

    fields = {c: "long" if c in longs else "string" for c in names} | {"key": kind, "segments": "array<struct<start_s: double, end_s: double>>"}
    n = max(1, min(manifest.count(), 4 * shuffle_partitions(spark)))
    return manifest.repartition(n).mapInArrow(run, ", ".join(f"{c} {t}" for c, t in fields.items())).withColumnRenamed("key", key)


def read_patches(spark: SparkSession, out: str, rows: DataFrame) -> DataFrame:
    """Rows (key as text, patch, start_s, end_s, sound, log_mel: [float]) from the tensor files that rows of `featured` name."""
    ship(spark)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("tensors").to_pylist():
                for x in batches_of(f"{out}/tensors/{name}"):
                    mel = x.column("log_mel").to_numpy_ndarray().reshape(len(x), PATCH * MELS).astype(np.float32)
                    values = pa.ListArray.from_arrays(pa.array(np.arange(0, mel.size + 1, PATCH * MELS), pa.int32()), pa.array(mel.ravel()))
                    yield pa.RecordBatch.from_arrays([x.column("key").cast(pa.string()), *(x.column(c) for c in ("patch", "start_s", "end_s", "sound")), values], ["key", "patch", "start_s", "end_s", "sound", "log_mel"])

    return rows.select("tensors").distinct().mapInArrow(run, "key string, patch long, start_s double, end_s double, sound boolean, log_mel array<float>")


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", out: str | None = None) -> DataFrame:
    """Rows (key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, tensors).

    feature: number of frames, patches and segments, seconds of sound, and a digest of the tensors as they were read back.
    """
    spark = df.sparkSession
    rows = featured(spark, store(df, out, key, text), key, df.schema[key].dataType.simpleString())
    sound = F.aggregate("segments", F.lit(0.0), lambda a, x: a + x["end_s"] - x["start_s"])
    feature = F.concat_ws(":", "frames", "patches", F.size("segments"), F.format_string("%.3f", sound), F.substring("tensor_sha256", 1, 16))
    return rows.select(key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "tensors")
