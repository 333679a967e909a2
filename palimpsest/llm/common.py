"""Shared pieces of the training-data operators: words, samples, cuts of lineage, batches."""

from __future__ import annotations

import os
import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word is a maximal run of characters other than the six ASCII blanks.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)

#: Text bytes that are hashed at once; temporaries take about 60 times as much. Longer texts are divided at blanks.
CHUNK_BYTES = 1 << 20
#: Rows and bytes of an Arrow batch, at most (a row that is larger comes alone).
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine's only where there is no other machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or os.path.join(tempfile.gettempdir(), "checkpoints")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder of the cluster and forget its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of few rows and bytes, so that long texts don't fill a Python worker.

    Plans read these settings when they run, so they stay set in the session; smaller ones are left alone.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        held = re.fullmatch(r"(-?[0-9]+)b?", str(spark.conf.get(f"spark.sql.execution.arrow.{name}")).lower())
        if held is None or not 0 < int(held[1]) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def named_apart(name: str, *taken: DataFrame) -> str:
    """``name``, or that with underscores in front, that no column of the tables has (whatever its case)."""
    held = {c.lower() for df in taken for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, keep: Column, limit: int) -> DataFrame:
    """Rows (doc_id, text, ``label``) of at most ``limit`` ids for which ``keep`` holds: those whose id hashes lowest.

    Only ids and labels travel to pick them; texts are read where they lie, by a broadcast of the
    ids picked. ``limit`` bounds what the learning step reads. Of contradicting labels of one id
    the largest counts; ids without a label, or null, are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label))
    ids = documents.where(keep).select("doc_id").distinct().join(known, "doc_id")
    picked = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()
    frame = documents.sparkSession.createDataFrame([tuple(r) for r in picked], ids.schema)
    return documents.select("doc_id", "text").join(F.broadcast(frame), "doc_id")


# --- hashing the words of whole Arrow batches ---------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * CHUNK_BYTES)
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _P)], dtype=np.uint64)
        _inverses = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, inverse)], dtype=np.uint64)
    return _powers[:n], _inverses[:n]


def text_chunks(column):
    """Yields (first row, bytes, offsets) of consecutive rows of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def hashed_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, places: bool = False):
    """Word hashes of consecutive texts and the first word of each text (one more entry at the end).

    With ``places``, also the words' first and past-the-end bytes in ``data``. A text above
    CHUNK_BYTES is hashed piece by piece.
    """
    if len(data) <= CHUNK_BYTES:
        h, starts, ends = _hashed(data, offsets, lower)
    else:
        parts = []
        for a, b in _pieces(data):
            inner = offsets[(offsets > a) & (offsets < b)] - a
            part = _hashed(data[a:b], np.r_[0, inner, b - a], lower)
            parts.append((part[0], part[1] + a, part[2] + a))
        h, starts, ends = (np.concatenate(p) for p in zip(*parts))
    first = np.searchsorted(starts, offsets)
    return (h, first, starts, ends) if places else (h, first)


def _pieces(data: np.ndarray):
    """Consecutive (start, end) of about CHUNK_BYTES that end at blanks; a longer word stays whole."""
    at = 0
    while at < len(data):
        end = at + CHUNK_BYTES
        while end < len(data):
            near = data[end : end + 4096]
            blank = np.flatnonzero((near == 32) | ((near >= 9) & (near <= 13)))
            if len(blank):
                end += int(blank[0])
                break
            end += 4096
        end = min(end, len(data))
        yield at, end
        at = end


def _hashed(data: np.ndarray, offsets: np.ndarray, lower: bool):
    """Hashes, first and past-the-end bytes of all words."""
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    brk = np.zeros(len(data) + 1, bool)
    brk[offsets] = True
    before = np.r_[False, inside[:-1]] if len(data) else inside
    after = np.r_[inside[1:], False] if len(data) else inside
    starts = np.flatnonzero(inside & (~before | brk[:-1]))
    ends = np.flatnonzero(inside & (~after | brk[1:])) + 1
    power, inverse = _tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    h = (total[ends] - total[starts]) * (inverse[starts] if len(starts) else np.zeros(0, np.uint64))
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts, ends


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first word of each text (one more entry at the end), and the words' first and past-the-end bytes."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    brk = np.zeros(len(data) + 1, bool)
    brk[offsets] = True
    starts = np.flatnonzero(inside & (~np.r_[False, inside[:-1]] | brk[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (~np.r_[inside[1:], False] | brk[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    return np.searchsorted(starts, offsets), starts, ends


def window_hashes(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``width`` words from each word on; the last ``width - 1`` words have none."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = np.uint64((2 * seed + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64))
    for j in range(width):
        out = out * factor + h[j : j + n]
    return mix(out + np.uint64(width))
