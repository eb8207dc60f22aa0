"""Structured Streaming versions of routing, retrieval and response clean-up (STR1, STR2).

Routing and clean-up are stateless projections built from the same functions as the batch
jobs, so a stream and a batch over the same rows give the same result.
Retrieval needs a ranking window, which a stream does not allow; it runs
per micro-batch in ``foreachBatch`` with the batch operator. Requests that a client sends again are answered once:
keyed state remembers ids until the watermark has passed them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sheaf.operators import postprocess as post_ops
from sheaf.operators import prompts as prompt_ops
from sheaf.operators import requests as req_ops
from sheaf.session import stored

REQUEST_SCHEMA = req_ops.REQUEST_SCHEMA
GENERATION_SCHEMA = "request_id bigint, question string, mode string, raw_response string"


def request_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(REQUEST_SCHEMA).parquet(path)


def timed_request_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Requests with the time ``asked_at``, for ``once``."""
    reader = spark.readStream.schema(f"{REQUEST_SCHEMA}, asked_at timestamp")
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def once(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first request of each ``request_id``; replays are dropped.

    The state of an id is kept until the watermark (the latest ``asked_at`` less ``delay``) has passed it, so it is bounded by
    the requests of that time. A replay within ``delay`` of the first is always recognised. A request that
    comes when the watermark (of the micro-batch before) has passed its time is late and is not answered: it can no longer
    be told from a replay.
    """
    return requests.withWatermark("asked_at", delay).dropDuplicatesWithinWatermark(["request_id"])


def routed_stream(requests: DataFrame) -> DataFrame:
    """STR1: CLS2-4 routing on a request stream."""
    return req_ops.route_requests(requests)


def cleaned_stream(generations: DataFrame) -> DataFrame:
    """STR2: TXT15 + TXT26 + TXT25 on a stream of generated answers."""
    return post_ops.respond(generations)


def start_to_parquet(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)\
        .outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def start_prompt_builder(routed: DataFrame, docs: DataFrame, path: str, checkpoint: str,
                         available_now: bool = True, vec_col: str | None = None) -> StreamingQuery:
    """STR1 with retrieval: each micro-batch meets the documents through VEC3.

    Pass an opened collection and ``vec_col``, so that no micro-batch encodes the documents again.
    """
    def per_batch(batch: DataFrame, batch_id: int) -> None:
        # one directory per batch id: a replayed batch overwrites itself (idempotent sink); the batch has several readers
        prompt_ops.assemble_prompts(stored(batch, "requests"), docs, vec_col=vec_col).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    w = routed.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
