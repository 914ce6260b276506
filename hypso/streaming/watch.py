"""Contours of raster files as they arrive in a folder.

Each micro-batch is a run of the engine over its new files. Identifiers go on from the batch
before: a table in the state folder has the ids that each batch ended with, so a batch that
runs again after a failure starts where it did and writes the same files.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import engine
from ..options import Options

SCHEMA = "path string, modificationTime timestamp, length long, content binary"
MARKS = "batch long, node long, way long"


def marks(spark: SparkSession, state: str) -> DataFrame:
    """The ids that come next after each batch."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{state}/marks")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(MARKS).parquet(f"{state}/marks") if there else spark.createDataFrame([], MARKS)


def contour_batch(files: DataFrame, batch: int, o: Options, state: str) -> None:
    """The run over one batch of files (path, content)."""
    spark = files.sparkSession
    if files.isEmpty():
        return
    last = marks(spark, state).where(F.col("batch") < batch).orderBy(F.desc("batch")).first()
    own = replace(o, start_node_id=last["node"] if last else o.start_node_id, start_way_id=last["way"] if last else o.start_way_id)
    _, node, way = engine.run(spark, own, files.select("path", "content"))
    row = (batch, node, way)
    spark.createDataFrame([row], MARKS).coalesce(1).write.mode("append").parquet(f"{state}/marks")


def watch(spark: SparkSession, folder: str, o: Options, state: str, glob: str = "*.{hgt,tif,tiff}", files_a_batch: int = 100, **trigger) -> StreamingQuery:
    """Start the stream; trigger: as for DataStreamWriter.trigger, availableNow=True by default."""
    new = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_a_batch).load(folder)
    writer = new.writeStream.option("checkpointLocation", f"{state}/stream").foreachBatch(lambda df, batch: contour_batch(df, batch, o, state))
    return writer.trigger(**(trigger or {"availableNow": True})).start()
