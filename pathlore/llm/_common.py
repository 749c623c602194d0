"""What the operators share: tables in the shared folder, Arrow helpers, null and name handling."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Name of the struct that carries a row's own columns past an operator's columns.
ROW = "_row"
#: Bytes in memory of a stored table that may be broadcast, as counted while it was written.
BROADCAST_BYTES = 32 << 20
#: Text that a task looks at together, in bytes.
SLICE_BYTES = 2 << 20
#: The local folder of a session without a shared one, made when first wanted.
_LOCAL: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the input folder, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where unset a local one, for a local master alone."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        conf = _LOCAL[0]
    return conf.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, not made yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _size(col: Column, kind: T.DataType) -> Column:
    """Bytes of a value, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col).cast("long"), F.lit(0))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            return F.coalesce(F.aggregate(col, F.lit(0).cast("long"), lambda n, x: n + _size(x, kind.elementType)), F.lit(0).cast("long"))
        return F.coalesce(F.greatest(F.size(col), F.lit(0)).cast("long") * 8, F.lit(0))
    if isinstance(kind, T.StructType):
        return sum((_size(col.getField(f.name), f.dataType) for f in kind.fields), F.lit(8))
    return F.lit(8)


def stored(df: DataFrame, name: str, mark: Column | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends here and survives lost executors.

    Its rows and bytes are counted as they are written: ``rows_of`` and ``bounded`` tell them without another job.
    So is ``mark``, an aggregate that is the table's ``stored_mark``.
    """
    path, seen = new_folder(df.sparkSession, name), Observation()
    size = sum((_size(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(32))
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes"), (F.lit(None) if mark is None else mark).alias("mark"))
    counted.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_rows, out.stored_bytes, out.stored_mark = seen.get["rows"], seen.get["bytes"] or 0, seen.get["mark"]
    return out


def rows_of(table: DataFrame) -> int:
    """Rows of a stored table."""
    return table.stored_rows


def bounded(table: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """table, made row by row of a stored one (itself by default), marked for broadcast if that one's counted bytes are few;
    else joins shuffle, and split keys that many rows have."""
    return F.broadcast(table) if (table if of is None else of).stored_bytes <= BROADCAST_BYTES else table


def dealt(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """df as a table in the shared folder, dealt once by a key: joins by it leave this table's rows where they are."""
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    rows = df.repartition(buckets, key).write.bucketBy(buckets, key).format("parquet").option("compression", "zstd")
    rows.option("path", new_folder(df.sparkSession, name)).saveAsTable(table)
    return df.sparkSession.table(table)


class Tables(list):
    """Stores tables as stored() does and remembers them, so that those no longer needed can be removed together."""

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.append(stored(df, name))
        return self[-1]

    def drop(self, *keep: DataFrame) -> None:
        for table in self:
            if not any(table is k for k in keep):
                drop_stored(table)
        self.clear()


def drop_stored(df: DataFrame) -> None:
    """Removes the files of a stored table that no plan needs any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def packed(df: DataFrame) -> Column:
    """All columns of df in one struct, so that an operator's own names cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW)


def unpacked(df: DataFrame, columns: Sequence[str], new: Sequence[str]) -> DataFrame:
    """The row's own columns and then the new ones; an own column with a new one's name gives way to it."""
    gone = {n.lower() for n in new}
    own = [F.col(ROW).getField(c).alias(c) for c in columns if c.lower() not in gone]
    return df.select(*own, *[F.col(c) for c in new])


def slices(batch: pa.RecordBatch, limit: int | None = None, rows: int = 30_000) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about so many bytes of strings (one row at least), so that long rows don't add up."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            size += pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // (SLICE_BYTES if limit is None else limit)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        for c in range(a, b, rows):
            yield batch.slice(c, min(rows, b - c))


def arrow_columns(
    df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], new: Sequence[tuple[str, T.DataType]], drop: Sequence[str] = ()
) -> DataFrame:
    """df with columns that a function makes of each slice of rows (one array per new column, as long as the slice).

    start makes that function, once for each task: what it remembers between slices goes with the task. Every other
    column passes through as it is, but for those in drop, which don't come back.
    """
    schema = T.StructType([*[f for f in df.schema.fields if f.name not in drop], *[T.StructField(n, t) for n, t in new]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = start()
        for batch in batches:
            own = [n for n in batch.schema.names if n not in drop]
            for part in slices(batch) if batch.num_rows else ():
                yield pa.RecordBatch.from_arrays([*[part[n] for n in own], *fn(part)], names=[*own, *[n for n, _ in new]])

    return df.mapInArrow(run, schema)
