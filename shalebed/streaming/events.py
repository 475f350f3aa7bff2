"""Events of a stream handed to handlers by class."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Handler = Callable[[DataFrame, int], None]


def matching(events: DataFrame, name: str, column: str) -> DataFrame:
    """Events for a handler: all for a name that begins with `all-`, else those whose class has the part before the first dash as its last part or as a whole."""
    prefix = name.split("-", 1)[0]
    return events if prefix == "all" else events.where((F.col(column) == prefix) | F.col(column).endswith("." + prefix))


def dispatch(events: DataFrame, handlers: dict[str, Handler], column: str, checkpoint: str) -> StreamingQuery:
    """Every batch of a stream is given to each handler (name to function of rows and batch number) in order of name.

    All that is there now is handled, then the query stops. A batch may come again after a failure, with its number.
    """

    def each(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for name in sorted(handlers):
                handlers[name](matching(kept, name, column), number)
        finally:
            kept.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay_once(rows: DataFrame, applied: DataFrame, seq: str, keys: list[str]) -> DataFrame:
    """Log rows above what has been applied to their key (keys and seq): the same log twice has no more effect than once."""
    done = applied.select(*keys, F.col(seq).alias("_done"))
    return rows.join(done, keys, "left").where(F.col("_done").isNull() | (F.col(seq) > F.col("_done"))).drop("_done")
