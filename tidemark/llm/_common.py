"""What the operators of this subpackage share: the shared work folder, tables
written to cut lineage, the hold-out rule and a per-worker cache of token rows."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Data of at most so many bytes is broadcast; anything larger is joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: A batch of rows that a task hands to Python holds about so many bytes, where the session sets nothing else.
BATCH_BYTES = 4 << 20


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is
    unset, a temporary one if all runs in one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str | int) -> DataFrame:
    """df written to the shared folder and read again. Lineage ends there, so a
    lost executor costs a re-read and not a re-computation."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def freed(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that nothing reads any more, if they were stored, and has the driver collect
    garbage, upon which Spark removes the shuffle files of finished steps."""
    for t in tables:
        if not hasattr(t, "_stored"):
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(t._stored)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark._jvm.System.gc()


def small(df: DataFrame, n_bytes: int) -> DataFrame:
    """A broadcast hint for df if its proven size allows one."""
    return F.broadcast(df) if n_bytes <= BROADCAST_BYTES else df


def small_batches(spark: SparkSession) -> None:
    """Bounds what a task holds of its rows at once, on both sides of the way to Python: Spark's
    own bound is 64 MB, so that a batch would be the whole of a task's part of a file."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def with_fields(df: DataFrame, column: str, ddl: str) -> T.StructType:
    """The schema of a column of df, whatever its fields are called, and more fields."""
    return T.StructType([df.schema[column], *T.StructType.fromDDL(ddl).fields])


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def sampled(df: DataFrame, key: str, n: int, most: int) -> DataFrame:
    """About `most` of the n rows of df, chosen by a hash of the key."""
    if n <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def lowered(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: For bytes.translate: A-Z to a-z.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def texts(batch: pa.RecordBatch | pa.Table, name: str = "text") -> list[str]:
    """The column's strings, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


class TokenTable:
    """Rows of numbers for tokens, computed once for each token a worker meets.

    `rows` maps a list of tokens to an array with a row for each. The table is
    emptied when it holds more than `most` tokens, which bounds its memory."""

    class _Ids(dict):
        def __init__(self) -> None:
            super().__init__()
            self.new: list[str] = []

        def __missing__(self, token: str) -> int:
            self[token] = n = len(self)
            self.new.append(token)
            return n

    def __init__(self, rows: Callable[[list[str]], np.ndarray], most: int = 150_000) -> None:
        self.rows, self.most = rows, most
        self.ids, self.table = self._Ids(), None

    def of(self, docs: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All documents' token rows, one after the other, and each document's
        number of tokens."""
        if len(self.ids) > self.most:
            self.ids, self.table = self._Ids(), None
        look, flat, counts = self.ids.__getitem__, [], []
        for tokens in docs:
            counts.append(len(tokens))
            flat.extend(map(look, tokens))
        if self.ids.new or self.table is None:
            new = np.asarray(self.rows(self.ids.new))
            self.table = new if self.table is None else np.concatenate([self.table, new])
            self.ids.new = []
        return self.table[np.array(flat, dtype=np.int64)], np.array(counts, dtype=np.int64)


def segment_sum(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; a run of none gives zeros."""
    out = np.zeros((len(counts), *rows.shape[1:]), dtype=np.float64)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(rows, starts[full], axis=0)
    return out


def chunks(batch: pa.RecordBatch, n_chars: int = 3_000_000, column: str = "text") -> Iterable[pa.RecordBatch]:
    """Slices of the batch with about n_chars of text each, so that working
    arrays stay small where texts are long."""
    lengths = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if lengths.sum() <= n_chars:
        yield batch
        return
    part = np.cumsum(lengths) // n_chars
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(int(a), int(b - a))


def in_one_task(rows: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """fit's result for a bounded table, computed in one executor task and sent to
    the driver. Numpy's libraries run with the task's cores there."""
    held = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields]
    none = pa.table({n: pa.array([], _EMPTY.get(k, pa.string())) for n, k in held})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        found = list(batches)
        model = fit(pa.Table.from_batches(found) if found else none)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    one = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(one[0][0]) if one else fit(none)  # a plan known to be empty runs no task


_EMPTY = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
