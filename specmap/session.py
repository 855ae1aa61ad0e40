"""What the library needs from the session: a place to cut lineage, and the parallelism to size blocks by."""
import shutil
import tempfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's checkpoint folder; only a local session without one gets a scratch folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="specmap-checkpoint-")
    sc.setCheckpointDir(configured)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and return a table read from there.

    Everything an iteration or a second consumer re-reads goes through here, so a lost executor costs a re-read
    of the written rows, never a replay of the loop.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """`cut`, with the size that the rows have instead of the planner's estimate.

    A checkpoint keeps the estimate of its plan, and a join multiplies those of its sides. In a loop that joins a table
    with what came of it, the estimate's digits double each round, until planning alone takes minutes. A cached
    table has its real size; the written copy takes it over.
    """
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    held.count()
    out = cut(held)
    held.unpersist()
    return out


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers whatever folder the session was started in (once per session)."""
    sc = spark.sparkContext
    if getattr(sc, "_specmap_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="specmap-ship-")
    sc.addPyFile(shutil.make_archive(f"{folder}/specmap", "zip", root.parent, root.name))
    sc._specmap_shipped = True
