"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Fixed value: the ASCII white space of the text contracts.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the one the session names; a temporary one only under a local master."""
    sc = spark.sparkContext
    now = sc.getCheckpointDir()
    if now:
        return now
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="vantrail-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage is cut, so a lost executor costs a re-read and nothing more,
    later reads take the columns they need, and the planner knows the size (a plan of many checkpoints multiplies sizes it can
    only guess). The tables stay until ``clear_scratch``."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables that ``checkpointed`` wrote in this application; DataFrames that read them can't be used after it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/tables")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch, which texts of any length fill fast.
ARROW_BYTES = 8 << 20


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package also when the driver found it through sys.path only, and bound the session's Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (have, ROOT) if x)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def utf8(column: Column) -> Column:
    return column.cast("binary")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that names of an operator's own can't clash with them; ``select("row.*")`` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


#: Rows that are broadcast at most; beyond them the same join shuffles.
MARKS = 1 << 18


def bounded(table: DataFrame) -> DataFrame:
    """A side of a join that is broadcast where it has at most MARKS rows; count a written table only."""
    return F.broadcast(table) if table.count() <= MARKS else table


def drop_marked(rows: DataFrame, dropped: DataFrame, repeated: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` without those whose identity ``names`` is in ``dropped``, and with one each of those in ``repeated``; no identity is in both.

    Up to MARKS identities are broadcast and rows stay where they are; beyond that rows and identities meet in a shuffle.
    """
    acts = dropped.select(*names, F.lit(True).alias("__gone")).unionByName(repeated.select(*names, F.lit(False).alias("__gone"))).distinct()
    acts = checkpointed(acts.select(*[F.col(n).alias(f"{n}_of") for n in names], "__gone"))
    once = not acts.where("not __gone").isEmpty()
    same = F.xxhash64(*names) == F.xxhash64(*[f"{n}_of" for n in names])
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_of"))
    marked = rows.join(bounded(acts), same, "left").drop(*[f"{n}_of" for n in names])
    clear = marked.where(F.col("__gone").isNull()).drop("__gone")
    if once:
        clear = clear.unionByName(marked.where("not __gone").drop("__gone").dropDuplicates(names))
    return clear.drop(*names)


def _end(at: np.ndarray, lo: int, limit: int) -> int:
    return max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)


def list_slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches in slices of at most SLICE / 8 list items or one row."""
    for batch in batches:
        at = np.concatenate([[0], np.cumsum(batch.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        lo = 0
        while lo < batch.num_rows:
            hi = _end(at, lo, SLICE // 8)
            yield batch.slice(lo, hi - lo)
            lo = hi


#: Bytes of text a worker takes apart at once; one longer text is taken alone.
SLICE = 1 << 22


def text_slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches in slices of at most SLICE bytes of text or one row, with the UTF-8 bytes of the texts and their offsets. A null text is empty."""
    for batch in batches:
        texts = batch.column(column)
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        _, where, data = texts.buffers()
        at = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        lo = 0
        while lo < len(texts):
            hi = _end(at, lo, SLICE)
            yield batch.slice(lo, hi - lo), bytes_[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            lo = hi
