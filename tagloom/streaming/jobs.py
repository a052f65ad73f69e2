"""Running a stream to the end of its input and reading the result back."""
from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import NAMESPACE_URL, uuid4, uuid5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.stats import latest
from ..session import checkpoint_folder
from ..sources import merged as M
from .ttl import ROCKS

END = "9999-01-01 00:00:00"  # event time of the row that ends an input


def new_place(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid4().hex}"


def drain_append(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All rows that a stream emits, in a folder of the shared checkpoint area with one part for a micro-batch. ``mode`` is that of the operators."""
    spark, place = stream.sparkSession, new_place(stream.sparkSession, name)
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", place + "/rows").option("checkpointLocation", place + "/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(place + "/rows")
    _drain(stream, place, mode)
    return _batches(stream, place).drop("batch")


def _drain(stream: DataFrame, place: str, mode: str):
    """Runs a stream to its end. Rewriting a batch after a failure overwrites that batch's own folder, so the result stays exact."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/rows/batch={epoch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", place + "/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def _batches(stream: DataFrame, place: str) -> DataFrame:
    """The rows of all batches with their number; none if no batch ran."""
    spark, schema = stream.sparkSession, StructType([*stream.schema.fields, StructField("batch", LongType())])
    folder = spark._jvm.org.apache.hadoop.fs.Path(place + "/rows")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(place + "/rows")


@contextmanager
def timed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that state with timers needs, for the streams started inside; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def drain_update(stream: DataFrame, name: str, keys: list[str], progress: list[dict] | None = None) -> DataFrame:
    """Update-mode stream: the newest row of each key. ``progress`` receives what the query reported of its batches."""
    place = new_place(stream.sparkSession, name)
    q = _drain(stream, place, "update")
    if progress is not None:
        progress += [json.loads(p.json) for p in q.recentProgress]
    return latest(_batches(stream, place), keys, ["batch"]).drop("batch")


def drain_closed(events: DataFrame, closed: Callable[[DataFrame], DataFrame], name: str, time: str = "ts") -> DataFrame:
    """Append-mode stream of what the watermark closes, and at the end of the input of all that is still open.

    ``closed`` aggregates ``events`` under a watermark. The end of input is told by one late-dated row without keys, from a folder that is read next
    to the events and empty until they have run out: it moves the watermark past every open window, and its own never closes.
    """
    spark, place = events.sparkSession, new_place(events.sparkSession, name)
    end = spark.createDataFrame([(END,)], "t string").select(F.to_timestamp("t").alias(time))
    end = end.select(*[F.col(time) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema])
    end.limit(0).write.parquet(place + "/end")
    stream = closed(events.unionByName(spark.readStream.schema(end.schema).parquet(place + "/end")))
    for last in (False, True):
        if last:
            end.coalesce(1).write.mode("append").parquet(place + "/end")
        q = stream.writeStream.outputMode("append").format("parquet").option("path", place + "/rows").option("checkpointLocation", place + "/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(place + "/rows")


def merge_into(stream: DataFrame, path: str, keys: list[str], by: list[str], state: str, gone: Column | None = None, buckets: int = M.BUCKETS):
    """Each micro-batch is merged into the table at ``path`` (``sources/merged.py``): the newest row of each key stays. A repeated batch changes nothing."""
    def write(batch: DataFrame, epoch: int) -> None:
        M.merge(batch, path, keys, by, epoch, state, gone, buckets)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def append_missing(stream: DataFrame, target: str, keys: str | list[str], compute: Callable[[DataFrame], DataFrame], state: str, buckets: int = M.BUCKETS):
    """Incremental features: each micro-batch computes only keys that ``target`` lacks, each once, and appends them.

    ``target/_index`` holds the present keys in hash buckets, so a batch reads the key files of its own buckets and no features. ``compute`` gives the key
    columns, the features and optionally ``error``: a row with an error is not kept, and its key is tried again when it comes again. The features of a batch are
    a folder of their own, which counts once the index names its keys; a batch that failed in between is written over.
    """
    keys = [keys] if isinstance(keys, str) else keys

    def write(batch: DataFrame, epoch: int) -> None:
        spark, index = batch.sparkSession, target + "/_index"
        schema = StructType([*[batch.schema[k] for k in keys], StructField("_part", StringType())])
        part = f"{uuid5(NAMESPACE_URL, state).hex}-{epoch}"
        if M.version(spark, index).batches.get(state, -1) >= epoch:
            return
        found = compute(M.missing(batch.dropDuplicates(keys), index, keys, schema))
        if "error" in found.columns:
            found = found.where("error IS NULL").drop("error")
        place = f"{target}/part={part}"
        found.write.mode("overwrite").parquet(place)
        present = spark.read.schema(found.schema).parquet(place).select(*keys, F.lit(part).alias("_part"))
        M.merge(present, index, keys, ["_part"], epoch, state, buckets=buckets)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def features(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """What ``append_missing`` has computed, with ``part``, the batch it came in; batches that are not finished are left out."""
    done = {uuid5(NAMESPACE_URL, state).hex: last for state, last in M.version(spark, target + "/_index").batches.items()}
    parts = [n.removeprefix("part=").split("-") for n in M.names(spark, target) if n.startswith("part=")]
    places = [f"{target}/part={who}-{k}" for who, k in parts if int(k) <= done.get(who, -1)]
    if not places:
        return spark.createDataFrame([], schema + ", part string")
    return spark.read.schema(schema + ", part string").option("basePath", target).parquet(*places)
