"""What the operators of this subpackage share: tables kept between jobs and
vectorised word handling on Arrow string buffers.

The word helpers run inside tasks on one Arrow batch at a time. They work on
UTF-8 bytes, because every separator that the operators use is an ASCII byte and
only A-Z is lower-cased. Nulls count as empty texts.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles at once; a longer text is one step.
BLOCK_BYTES = 2 << 20
#: Bytes that may be broadcast, as counted rows times a row's width; beyond it a
#: shuffled join is used.
BROADCAST_BYTES = 32 << 20


#: Bytes of one Arrow batch on its way to a Python worker.
BATCH_BYTES = 16 << 20


# --- tables between jobs -------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only if it is unset one of our own: in
    the warehouse, which a cluster shares, or in the temporary folder of a local master."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        folder = f"file://{os.path.join(tempfile.gettempdir(), 'corvane-shared')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/corvane-shared"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that long texts need no more memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a
    lost executor costs no recomputation of what stands before."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table of keep() that no later job reads."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def checked_broadcast(df: DataFrame, rows: int, width: int = 16) -> DataFrame:
    """Broadcast hint if the counted rows of `width` bytes fit; else the join shuffles."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


# --- words on byte buffers -----------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LONG_WORD = 64
_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most limit bytes of text each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = string_offsets(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, int(offsets[start]) + limit, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def string_offsets(array: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    return np.frombuffer(array.buffers()[1], kind, len(array) + 1, array.offset * np.dtype(kind).itemsize)


class Words:
    """Lower-cased words of a string array: data holds all bytes, starts and ends
    bound each word, doc is its row and first[d]..first[d+1] are the words of row d."""

    def __init__(self, array: pa.Array, lower: bool = True, separators: np.ndarray = _SPACE):
        offsets = string_offsets(array).astype(np.int64)
        low, high = int(offsets[0]), int(offsets[-1])
        body = array.buffers()[2]
        data = np.frombuffer(body, np.uint8)[low:high] if body is not None and high > low else np.zeros(0, np.uint8)
        self.data = _LOWER[data] if lower else data
        offsets = offsets - low
        inside = ~separators[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets, "left")
        self.doc = np.repeat(np.arange(len(array)), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word, one vectorised step per byte position."""
        size = self.ends - self.starts
        value = mix64(size.astype(np.uint64) + np.uint64(0x51ED270B))
        live = np.flatnonzero(size <= _LONG_WORD)
        at = 0
        while len(live):
            value[live] = value[live] * _MUL + self.data[self.starts[live] + at].astype(np.uint64) + np.uint64(1)
            at += 1
            live = live[size[live] > at]
        for i in np.flatnonzero(size > _LONG_WORD):
            word = self.data[self.starts[i] : self.ends[i]].astype(np.uint64)
            power = np.cumprod(np.full(len(word), _MUL))
            value[i] += np.sum(mix64(word + power))
        return mix64(value)

    def texts(self, which: np.ndarray) -> list[bytes]:
        raw, starts, ends = self.data.tobytes(), self.starts, self.ends
        return [raw[starts[i] : ends[i]] for i in which]


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k-word shingle and its row; a row with fewer words, but not
    none, has its whole sequence as its one shingle. Repeats are kept."""
    hashes, n = words.hashes(), len(words.doc)
    counts = np.diff(words.first)
    total, factor = np.zeros(n, np.uint64), 1
    for j in range(k):
        factor = (factor * 0xD6E8FEB86659FD93 + 2) % 2**64
        if j >= n:
            break
        same = words.doc[j:] == words.doc[: n - j]
        total[: n - j] += np.where(same, mix64(hashes[j:] + np.uint64(factor)), np.uint64(0))
    within = np.arange(n) - words.first[words.doc]
    valid = (within + k <= counts[words.doc]) | (within == 0)
    return mix64(total[valid]), words.doc[valid]


def distinct_per_row(values: np.ndarray, doc: np.ndarray, rows: int) -> list[np.ndarray]:
    """Sorted distinct values of each row; doc ascends."""
    first = np.searchsorted(doc, np.arange(rows + 1))
    return [np.unique(values[first[d] : first[d + 1]]) for d in range(rows)]
