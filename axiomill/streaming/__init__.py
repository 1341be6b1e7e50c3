"""Materialisation of a stream of triples, micro-batch by micro-batch.

Facts never expire and their order does not matter, so late rows need no watermark:
each batch is added to the closure like any other addition. A batch that is
delivered again finds all its triples there and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from axiomill.plans.fixpoint import Closure


class StreamingClosure:
    """A closure that follows a streaming frame (s, p, o).

    The closure is committed after each batch with the batch's number. To go on after a
    stop, open the same closure (``Closure.open``) and start on the same checkpoint: a batch
    that was committed is passed over, one that was broken off is added again.
    """

    def __init__(self, closure: Closure):
        self.closure = closure

    @property
    def last_batch(self) -> int:
        return self.closure.marks.get("batch", -1)

    def _take(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last_batch:
            return
        self.closure.add(batch.select("s", "p", "o"))
        self.closure.marks["batch"] = batch_id
        self.closure.commit()

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer: DataStreamWriter = stream.writeStream.foreachBatch(self._take).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()
