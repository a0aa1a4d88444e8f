"""What operators and jobs need of a session: the shared folder for tables they cut plans with, and workers that find this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the one spark.checkpoint.dir names; a temporary one only under a local master."""
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


def written(table: DataFrame) -> DataFrame:
    """``table`` written to the shared folder and read back: what follows reads it as often as it likes, also after an executor is lost."""
    path = f"{shared_dir(table.sparkSession)}/tables/{uuid.uuid4().hex}"
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


#: Rows that a task of ``dealt`` rows holds, whatever the size of the table.
TASK_ROWS = 1 << 17


def dealt(table: DataFrame, *keys: str, rows: int = TASK_ROWS) -> DataFrame:
    """``table`` written and dealt by ``keys`` into as many tasks as it has times ``rows`` rows: windows and sorts by these keys (and more) follow
    without another shuffle, and what a task sorts does not grow with the table. Rows of a key stay together."""
    table = written(table)
    return table.repartition(max(1, -(-table.count() // rows)), *keys)


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package also where the driver found it through sys.path only."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (have, ROOT) if x)
