"""Chroma fingerprints of audio in a binary column, and their alignment.

A recording (WAV bytes, PCM) is mixed to mono, brought to ``RATE`` and cut into overlapping
frames; each frame's spectrum is folded into twelve pitch classes. Sixteen filters compare
areas of that image - sums that an integral image gives in four look-ups - and each filter's
answer takes two bits of a 32-bit integer, so a recording becomes a list of integers.

Two recordings are aligned by an offset histogram: every integer that both hold votes for the
difference of its places. One integer alone votes, as noise seldom leaves several in a row
whole; an integer that repeats the one before it (silence, a steady tone) doesn't. The best
offset needs ``min_votes`` and an overlap of ``min_overlap`` integers (or of the whole shorter
recording), and the share of differing bits over the overlap must be at most ``max_error``.

The search takes a stated set of queries against all recordings, in blocks: recordings are
dealt by a hash to chunks of about ``chunk_ints`` integers, queries to blocks of about
``block_ints``, and a task holds one of each, the block as an inverted index. Votes are counted
there, part by part, so integers that many recordings share cost time but neither shuffle nor
memory, and only aligned pairs leave the task. Recordings with equal fingerprints are a class
and only its smallest id is searched, so copies cost nothing; nothing is dropped for being frequent.

Defined results: null, empty, torn or too short audio has an empty fingerprint, belongs to a
class of its own and matches nothing; ties between offsets go to the lower error, then the smallest
absolute, then smallest offset, ties between queries to the lower error, then the smaller id; rows that
repeat an id and audio are repeated in the result; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.sources import materialize, table

RATE, FRAME, HOP = 4000, 1024, 256
#: (kind, lowest pitch class, classes, frames): every kind at spread-out places of the image.
FILTERS = [(k % 4, (5 * k) % 12, 2 + k % 3, 3 + 2 * (k % 4)) for k in range(16)]
_WIDEST = max(f[3] for f in FILTERS)
_GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)


def read_wav(data: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1) and the rate of WAV bytes; no samples if they can't be read."""
    if not data:
        return np.zeros(0), RATE
    try:
        with wave.open(io.BytesIO(data)) as f:
            width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
            raw = f.readframes(f.getnframes())
    except (wave.Error, EOFError):
        return np.zeros(0), RATE
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float64) / 128 - 1
    elif width in (2, 4):
        x = np.frombuffer(raw[: len(raw) // width * width], f"<i{width}").astype(np.float64) / 2 ** (8 * width - 1)
    elif width == 3:
        low, mid, top = (np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8)[i::3].astype(np.int64) for i in range(3))
        x = (((top ^ 0x80) - 0x80) * 65536 + mid * 256 + low) / 2**23
    else:
        return np.zeros(0), RATE
    x = x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1)
    return x, rate


def write_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    """16-bit mono WAV bytes."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def _folding() -> np.ndarray:
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    use = (hz >= 55) & (hz <= 1760)
    fold = np.zeros((len(hz), 12))
    fold[np.flatnonzero(use), np.round(12 * np.log2(hz[use] / 440)).astype(int) % 12] = 1
    return fold


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Energies of the twelve pitch classes, one row per frame, each row scaled to length 1."""
    if rate != RATE and len(samples):
        at = np.arange(0, len(samples) - 1, rate / RATE)
        samples = np.interp(at, np.arange(len(samples)), samples)
    n = (len(samples) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.empty((n, 12))
    fold, window = _folding(), np.hanning(FRAME)
    for i in range(0, n, 512):  # a long recording is transformed part by part
        spectrum = np.abs(np.fft.rfft(frames[i : i + 512] * window, axis=1)) ** 2
        out[i : i + 512] = spectrum @ fold
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(length > 1e-6, out / np.maximum(length, 1e-12), 0.0)


def fingerprint(data: bytes | None) -> np.ndarray:
    """The packed 32-bit integers of WAV bytes."""
    image = chroma(*read_wav(data))
    n = len(image) - _WIDEST + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    around = np.concatenate([image, image], axis=1)  # pitch classes go round
    total = np.zeros((len(image) + 1, 25))
    total[1:, 1:] = around.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(frame: int, frames: int, low: int, high: int) -> np.ndarray:
        a, b = t + frame, t + frame + frames
        return total[b, high] - total[a, high] - total[b, low] + total[a, low]

    out = np.zeros(n, np.uint32)
    for kind, low, size, width in FILTERS:
        high, half = low + size, (width + 1) // 2
        whole = area(0, width, low, high)
        if kind == 0:  # this band against the rest
            part, rest, scale = whole, area(0, width, low, low + 12), size / 12
        elif kind == 1:  # earlier against later
            part, rest, scale = area(0, half, low, high), whole, half / width
        elif kind == 2:  # lower classes against the upper
            part, rest, scale = area(0, width, low, low + size // 2), whole, (size // 2) / size
        else:  # the middle third of the time against all
            third = max(1, width // 3)
            part, rest, scale = area(third, third, low, high), whole, third / width
        value = (part + 0.02) / (rest + 0.02 / scale) - scale
        level = (value > -0.1 * scale).astype(int) + (value > 0) + (value > 0.1 * scale)
        out = (out << np.uint32(2)) | _GRAY[level]
    return out


def align(a: np.ndarray, b: np.ndarray, offset: int) -> float:
    """The share of bits that differ where ``a[i]`` meets ``b[i - offset]``; 1 without overlap."""
    low, high = max(0, offset), min(len(a), len(b) + offset)
    if high <= low:
        return 1.0
    return float(np.bitwise_count(a[low:high] ^ b[low - offset : high - offset]).mean() / 32)


def landmarks(prints: np.ndarray) -> np.ndarray:
    """The places of the integers that vote: those that differ from the one before."""
    return np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])) if len(prints) else np.zeros(0, np.int64)


class QueryIndex:
    """The landmarks of a block of queries, by value."""

    def __init__(self, prints: list[np.ndarray]) -> None:
        self.prints = prints
        places = [landmarks(x) for x in prints]
        values = np.concatenate([np.zeros(0, np.uint32), *(x[at] for x, at in zip(prints, places))])
        order = np.argsort(values, kind="stable")
        self.values = values[order]
        self.query = np.repeat(np.arange(len(prints)), [len(x) for x in places])[order]
        self.place = np.concatenate([np.zeros(0, np.int64), *places])[order]

    def votes(self, prints: np.ndarray, most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``query, offset, votes`` of a recording, merged part by part: about ``most`` equal pairs are held at a time."""
        at = landmarks(prints)
        low, high = (np.searchsorted(self.values, prints[at], side) for side in ("left", "right"))
        shift = len(prints)
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin, seen = 0, np.cumsum(high - low)
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(seen, (seen[begin - 1] if begin else 0) + most, "right")))
            n = (high - low)[begin:end]
            hit = np.repeat(low[begin:end] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            new = (self.query[hit] << 40) + (self.place[hit] - np.repeat(at[begin:end], n) + shift)
            new, times = np.unique(new, return_counts=True)
            if len(codes):
                new, back = np.unique(np.concatenate([codes, new]), return_inverse=True)
                times = np.bincount(back, weights=np.concatenate([counts, times])).astype(np.int64)
            codes, counts, begin = new, times, end
        return codes >> 40, (codes & ((1 << 40) - 1)) - shift, counts

    def matches(self, prints: np.ndarray, min_votes: int, max_error: float, min_overlap: int) -> list[tuple[int, int, int, float]]:
        """``(query, offset, votes, bit error)`` of each query that aligns with a recording; offsets count from the query's start."""
        query, offset, votes = self.votes(prints)
        size = np.array([len(x) for x in self.prints], np.int64)[query]
        overlap = np.minimum(size, len(prints) + offset) - np.maximum(0, offset)
        use = (votes >= min_votes) & (overlap >= np.minimum(min_overlap, np.minimum(size, len(prints))))
        query, offset, votes = query[use], offset[use], votes[use]
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
        top = np.repeat(np.maximum.reduceat(votes, first) if len(first) else votes, np.diff(np.append(first, len(query))))
        best: dict[int, tuple] = {}
        for q, o, v in zip(query[votes == top].tolist(), offset[votes == top].tolist(), votes[votes == top].tolist()):
            found = (align(self.prints[q], prints, o), abs(o), o, v)
            if q not in best or found < best[q]:
                best[q] = found
        return [(q, o, v, error) for q, (error, _, o, v) in best.items() if error <= max_error]


def fingerprints(media: DataFrame, id_col: str, audio_col: str) -> DataFrame:
    """``id, prints (array<int>), digest`` of each row; the digest is null for an empty fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.view(np.int32) for x in found], pa.list_(pa.int32())), pa.array([xxhash.xxh3_128_hexdigest(x.tobytes()) if len(x) else None for x in found])],
                names=["id", "prints", "digest"],
            )

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(F.col(id_col).alias("id"), F.col(audio_col).alias("audio")).mapInArrow(run, f"id {kind}, prints array<int>, digest string")


def search(
    printed: DataFrame, queries: DataFrame, min_votes: int = 2, max_error: float = 0.2, min_overlap: int = 16, chunk_ints: int = 100_000, block_ints: int = 1_000_000
) -> DataFrame:
    """Aligned pairs of ``queries`` (``id, prints``) and ``printed``: ``query_id, match_id, offset, votes, bit_error``.

    Ids are to be distinct on either side. A recording isn't paired with itself.
    """
    ints = lambda df: df.agg(F.coalesce(F.sum(F.size("prints")), F.lit(0))).first()[0]
    chunks, blocks = max(1, -(-ints(printed) // chunk_ints)), max(1, -(-ints(queries) // block_ints))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(dealt(blocks).alias("block"), every(chunks).alias("chunk"), F.col("id").alias("q_id"), F.col("prints").alias("q_prints"))
    right = printed.select(every(blocks).alias("block"), dealt(chunks).alias("chunk"), F.col("id").alias("m_id"), F.col("prints").alias("m_prints"))
    kind = printed.schema["id"].dataType.simpleString()

    def lists(column: pa.ChunkedArray) -> list[np.ndarray]:
        return [np.asarray(x.values if x.is_valid else [], np.int32).view(np.uint32) for part in column.chunks for x in part]

    def run(asked: pa.Table, media: pa.Table) -> pa.Table:
        kind, found = media.schema.field("m_id").type if len(media) else asked.schema.field("q_id").type, []
        if len(asked) and len(media):  # a side without rows has no columns
            index, own = QueryIndex(lists(asked["q_prints"])), asked["q_id"].to_pylist()
            for i, prints in zip(media["m_id"].to_pylist(), lists(media["m_prints"])):
                found += [(own[q], i, o, v, e) for q, o, v, e in index.matches(prints, min_votes, max_error, min_overlap) if own[q] != i]
        columns = zip(zip(*found) if found else [()] * 5, (kind, kind, pa.int32(), pa.int64(), pa.float64()))
        return pa.table([pa.array(x, t) for x, t in columns], names=["query_id", "match_id", "offset", "votes", "bit_error"])

    by = ("block", "chunk")
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, f"query_id {kind}, match_id {kind}, offset int, votes long, bit_error double")


def match_media(media: DataFrame, id_col: str = "id", audio_col: str = "audio", every: int = 20, min_votes: int = 2, max_error: float = 0.2) -> DataFrame:
    """Fingerprint all rows and search with those whose id is divisible by ``every``.

    One row per row: ``id, n_ints, digest, class_id, n_matches, best_query, best_offset,
    best_error``; matches are classes of queries other than the row's own class.
    """
    printed = materialize(fingerprints(media, id_col, audio_col), "prints")
    classes = printed.filter("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest").agg(
        F.min("id").alias("class_id"), F.max((F.pmod("id", F.lit(every)) == 0).cast("int")).alias("asked"), F.first("prints").alias("prints")
    )
    classes = materialize(classes.select("digest", "class_id", "asked", "prints"), "classes")
    heads = classes.select(F.col("class_id").alias("id"), "prints")
    pairs = search(heads, classes.filter("asked = 1").select(F.col("class_id").alias("id"), "prints"), min_votes, max_error)
    best = pairs.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("n_matches"),
        F.min(F.struct("bit_error", "query_id", "offset")).alias("b"),
    )
    own = printed.select("id", F.size("prints").cast("long").alias("n_ints"), F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest"))
    ids = classes.select(F.concat(F.lit("."), "digest").alias("c_digest"), "class_id")
    out = own.join(ids, F.concat(F.lit("."), "digest") == F.col("c_digest"), "left").withColumn("class_id", F.coalesce("class_id", "id"))
    return out.join(best, F.col("class_id") == F.col("match_id"), "left").select(
        "id",
        "n_ints",
        "digest",
        "class_id",
        F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"),
        F.col("b.query_id").alias("best_query"),
        F.col("b.offset").alias("best_offset"),
        F.round("b.bit_error", 6).alias("best_error"),
    )


def render_tones(vector: list[float] | None, notes: int = 16, note_s: float = 0.25) -> bytes | None:
    """A WAV melody that a vector spells: each group of numbers sets one note's two pitches and their balance.

    The driver's tables hold no recordings; this turns ``embeddings`` into an audio column.
    """
    if not vector:
        return None
    v = np.nan_to_num(np.asarray(vector, np.float64))
    v = np.resize(v, notes * 4).reshape(notes, 4) * np.sqrt(len(v))
    t = np.arange(int(RATE * note_s)) / RATE
    pitch = 220 * 2 ** (np.array([0, 3, 5, 7, 10, 12])[np.minimum((np.tanh(v[:, :2]) + 1) * 3, 5).astype(int)] / 12)
    loud = np.where(v[:, 2:] < 0, 0.2, 0.4)
    wave_ = sum(loud[:, k, None] * np.sin(2 * np.pi * pitch[:, k, None] * t) for k in (0, 1))
    return write_wav(wave_.ravel())


def audio_of_embeddings(embeddings: DataFrame) -> DataFrame:
    """``id, audio``: each vector as a melody."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 200):
                part = batch.slice(i, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([render_tones(x) for x in part.column(1).to_pylist()], pa.binary())], names=["id", "audio"])

    return embeddings.select(F.col("vec_id").alias("id"), "embedding").mapInArrow(run, "id long, audio binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_media(audio_of_embeddings(table(spark, sf_dir, "embeddings"))).withColumnRenamed("id", "vec_id")
