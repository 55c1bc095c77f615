"""Structured Streaming scoring (T1 on ``readStream``).

A fitted pipeline is stateless per row, so the same ``PipelineModel`` scores
a file stream micro-batch by micro-batch.  The checkpoint goes to the shared
folder named by ``spark.checkpoint.dir`` so a restarted query resumes
exactly once.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from assay.operators.scoring import batch_score


def stream_score(spark: SparkSession, model: PipelineModel, source_dir: str, schema: StructType,
                 sink_dir: str, checkpoint_dir: str, id_col: str, keep: Sequence[str] = (),
                 max_files_per_trigger: int = 64, once: bool = True):
    """Score every new parquet file under ``source_dir`` into ``sink_dir``.

    ``once=True`` drains what is there (``availableNow``) and returns after
    the query stops; otherwise the started query is returned.
    """
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(source_dir))
    scored = batch_score(model, src, id_col, keep)
    w = (scored.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    if once:
        q = w.trigger(availableNow=True).start()
        q.awaitTermination()
        return q
    return w.trigger(processingTime="10 seconds").start()


def scratch_dir(spark: SparkSession, *parts: str) -> str:
    """A folder under the session's shared checkpoint directory."""
    from assay.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark)
    base = base.replace("file:", "") if base.startswith("file:") else base
    return os.path.join(base, *parts)


def read_scored(spark: SparkSession, sink_dir: str) -> DataFrame:
    return spark.read.parquet(sink_dir)
