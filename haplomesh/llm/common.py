"""Helpers that every operator of the subpackage shares.

Defined results for odd input, valid for all operators here unless one says
otherwise: a null text is the empty text; ``doc_id`` may be null or repeated
(each input row gives its own output row); extra columns are never read, so
their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shingles import HASHES

BATCH_ROWS = 2_000  # rows of an Arrow batch where rows are whole documents and stages share their workers


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach: ``spark.checkpoint.dir``.

    Where the setting is absent a session on one machine gets a temporary folder
    once; on a cluster its absence is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="haplomesh-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_SCOPES: list[list[str]] = []  # folders made within each open scratch block


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The table goes when the application ends, or at the end of the innermost
    open :func:`scratch` block.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    where, files = _hadoop(spark, path)
    files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Tables made inside go at the end of the block, but for those that were given to ``keep``.

    Only results that no later plan reads may be left to go: whatever leaves the
    block is written inside it and kept.
    """
    made: list[str] = []
    _SCOPES.append(made)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = materialise(df, name)
        kept = made.pop()
        if len(_SCOPES) > 1:
            _SCOPES[-2].append(kept)
        return out

    try:
        yield keep
    finally:
        _SCOPES.remove(made)
        release_shuffles(spark)
        for path in made:
            drop_folder(spark, path)


@contextmanager
def setting(spark: SparkSession, key: str, value):
    """A session setting within a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished writes now: it does so when the driver's JVM collects their plans."""
    spark.sparkContext._jvm.System.gc()


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system through Spark's own Hadoop client."""
    where, files = _hadoop(spark, path)
    files.delete(where, True)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or its first variant that no column has (Spark compares names without case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def mark(text: Column) -> Column:
    """64-bit hash of a text as it is; beside its ``doc_id`` it tells apart the rows that repeat the id."""
    return F.xxhash64(text)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text (null: empty), under the names ``doc_id`` and ``text``."""
    return docs.select(*id_and_text_columns(id_col, text_col))


def id_and_text_columns(id_col: str = "doc_id", text_col: str = "text") -> list:
    return [F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")]


def small_batches(batches, budget: int = 8 << 20, column: str = "text"):
    """Cut Arrow batches so that each holds about ``budget`` bytes of text (one row at least)."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        offsets = value_offsets(col)
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + budget, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def bound_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches have ``BATCH_ROWS`` rows at most; a lower setting stays.

    The batches of whole documents that the JVM and each worker hold are otherwise
    of 10,000 rows.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def give_back() -> None:
    """Empty the word cache and return freed memory to the system."""
    HASHES.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def tidy(run):
    """The task function ``run``; at its end the worker gives memory back, as it lives on beside the stages that follow."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def value_offsets(col: pa.Array):
    """Byte offsets of a string or binary array's rows (length + 1 of them)."""
    import numpy as np

    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    buf = col.buffers()[1]
    if buf is None or buf.size == 0:
        return np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(buf, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def value_bytes(col: pa.Array) -> memoryview:
    """The bytes that ``value_offsets`` points into."""
    buf = col.buffers()[2]
    return memoryview(buf) if buf is not None else memoryview(b"")


ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


class Rows:
    """A mapInArrow output schema: its Spark form and a batch builder from columns."""

    def __init__(self, **fields: str):
        self.names = list(fields)
        self.kinds = [ARROW[k] for k in fields.values()]
        self.schema = T.StructType.fromDDL(", ".join(f"{n} {k.replace('long', 'bigint')}" for n, k in fields.items()))

    def batch(self, *columns) -> pa.RecordBatch:
        arrays = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, self.kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=self.names)
