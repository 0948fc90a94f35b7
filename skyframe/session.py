"""Session settings, durable cut points and size-checked broadcasts."""

from __future__ import annotations

import os
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Rows of one Arrow batch of whole texts, and its bytes. The stock 10,000 rows of a batch make
#: a Python worker grow with the texts.
TEXT_BATCH_ROWS = 256
TEXT_BATCH_BYTES = 8 << 20


def text_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds of whole texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BATCH_BYTES))


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings every job relies on. UTC makes naive feed epochs UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Keeps state outside the heap, however many keys a job has.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    # The virtual machine never compiles a method above 8,000 bytes, and whole orbit models in
    # one method would be interpreted. Beyond it projections are generated one by one.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Without one, a local master gets a folder below its warehouse. Any other master
    is refused: a folder on one machine loses data between machines.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    warehouse = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse")
    return os.path.join(warehouse.removeprefix("file:"), "_checkpoints")


def new_folder(spark: SparkSession, name: str = "stage") -> str:
    """A path in the shared folder that nothing has used yet."""
    application = spark.sparkContext.applicationId
    return f"{checkpoint_dir(spark)}/stages_{application}/{name}_{uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage like a checkpoint, but keeps column pruning, pushed filters
    and statistics for the steps that read it, and evaluates the last stage once.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of few bytes that mean much work each, dealt out over a fixed number of parts.

    Parts of a plain exchange are merged by their bytes, down to one a core or one more,
    which then runs alone after the others.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast only after counting that ``df`` holds at most ``max_rows`` rows.

    Past the bound the frame is returned as it is, and the join shuffles.
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df
