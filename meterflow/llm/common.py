"""Shared pieces: where intermediate tables go, size-checked joins and text rules."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts, in UTF-8: anything between ASCII white space, which no byte of another character is.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Characters (or bytes) above which a text's words are met one by one, and how many then make a list.
LAZY_CHARS = LAZY_BYTES = 1 << 22
WORD_LIST = 1 << 18
#: Rows up to which a table of fixed-width rows may be broadcast (about 16 MB as a hash relation).
BROADCAST_ROWS = 200_000


def words(text: str) -> Iterator[list[bytes]]:
    """Lists of the words of a text with A-Z in lower case, in UTF-8; a very long text in several lists.

    bytes.lower() changes A-Z only, and bytes.split() cuts at just the white space the contracts name.
    """
    data = text.encode().lower()
    if len(data) <= LAZY_BYTES:
        yield data.split()
        return
    held = []
    for m in WORD.finditer(data):
        held.append(m.group())
        if len(held) == WORD_LIST:
            yield held
            held = []
    yield held


def word_counts(text: str) -> Counter:
    """How often each word occurs."""
    counts: Counter = Counter()
    for some in words(text):
        counts.update(some)
    return counts


def released() -> None:
    """Gives back to the system what a worker's earlier tasks have freed: workers outlive tasks and stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def quoted(name: str) -> str:
    """A column's name as SQL takes it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def text_of(name: str = "text") -> Column:
    """The column as a string, null as empty."""
    return F.coalesce(F.col(quoted(name)).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the context's; where neither is set, a temporary one if all runs on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        own = spark._jsc.sc().getCheckpointDir()
        at = own.get() if own.isDefined() else None
    if not at:
        if not re.match(r"local(\[|-cluster\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = getattr(shared_dir, "own", None)
        if at is None:
            at = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="meterflow-")
    return at.rstrip("/")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, so that a lost executor costs no earlier stage.

    Unlike cached or locally checkpointed blocks the files outlive executors. They are removed when
    the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the files of what `written` gave, once nothing reads it any more; other frames are left alone."""
    path = getattr(df, "written_at", None)
    if path:
        _drop(df.sparkSession, path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  at exit the session may already have ended
        pass


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of fixed-width rows, marked for broadcast when its row count allows; else left to a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df.hint("merge")


#: What one record batch handed to Python may hold.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def lean(spark: SparkSession) -> SparkSession:
    """The session, with record batches bounded by bytes: ten thousand long texts at once would not fit a worker.

    Tighter settings of the caller stay. The bounds stay set in the session: its plans read them when they run.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.sub("[^0-9]", "", spark.conf.get(key)) or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))
    return spark


def slots(spark: SparkSession) -> int:
    """The partitions an explicit exchange is dealt to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def whole_groups(frames, keys: int):
    """(record batch, starts, ends) of whole groups, from batches sorted by their first `keys` columns of numbers.

    Only the group that is still open is held between batches.
    """
    import numpy as np
    import pyarrow as pa

    released()
    held = None
    for batch in frames:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches(max_chunksize=1 << 30)[0]
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        turns = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            turns |= c[1:] != c[:-1]
        starts = np.r_[0, np.flatnonzero(turns) + 1]
        if len(starts) > 1:
            yield batch.slice(0, starts[-1]), starts[:-1], starts[1:]
        held = batch.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held, np.array([0]), np.array([held.num_rows])
