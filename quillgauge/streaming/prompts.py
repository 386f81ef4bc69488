"""Prompt scoring as a stream: the progressive save of a long run.

The scoring is stateless, so a restart after a lost executor or driver goes on from the
checkpoint and the parquet sink holds every row exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quillgauge.operators.prompts import score_prompts


def read_prompt_stream(spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet", files: int = 100,
                       pattern: str | None = None) -> DataFrame:
    """New files of a folder, at most ``files`` per batch; ``pattern`` limits the names of the files.

    ``folder`` may be a glob: ``in/{prompts.parquet}`` reads that table whether it is one file or a folder of files.
    """
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder)


def score_prompt_stream(prompts: DataFrame, target: str, checkpoint: str, text: str = "prompt") -> StreamingQuery:
    """Score all available prompts into a parquet folder and stop."""
    return (
        score_prompts(prompts, text)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
