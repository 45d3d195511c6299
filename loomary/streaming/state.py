"""A vector table kept up to date by a stream of changes, with state for each path.

Events may come late, twice and in any order; what counts is their number (`seq`). The state of a path is the number of
its last event and whether it is there; a timer removes paths that no event has confirmed for a while. Each batch is one
commit of a log (sources.log), so readers see whole batches, and a batch that runs again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.log import COMMIT, Store

ENCODE, REMOVE = "encode", "remove"
#: The columns that a table of `synced` vectors has beside what the encoder makes.
MARKS = T.StructType([T.StructField("path", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("gone", T.BooleanType())])


def changes(events: DataFrame, keep_seconds: int = 0) -> DataFrame:
    """(path, seq, action, payload): what each batch of events changes, one row for a path that it changes.

    `events`: path, seq (long), at (timestamp), removed (boolean), payload (string). Of a path's events the one with the
    largest seq counts; one that isn't above the state's is late or a repeat and changes nothing (of events with equal seq
    in a batch, a removal counts, then the greatest payload). With keep_seconds, a path is removed once its last event lies
    further back than that behind the newest event of all, and such old events are not taken any more; a new one brings the
    path back. Without, nothing is too late. Null paths are left out; a null seq is below all others, a null time is 1970.
    """
    marked = events.filter("path is not null").select("path", F.coalesce("seq", F.lit(-(1 << 63))).alias("seq"), F.coalesce("at", F.timestamp_seconds(F.lit(0))).alias("at"), F.coalesce("removed", F.lit(False)).alias("removed"), "payload")

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, there = state.get if state.exists else (None, False)
        row = lambda action, payload=None: pd.DataFrame({"path": [key[0]], "seq": [seq], "action": [action], "payload": [payload]})
        if state.hasTimedOut:
            state.update((seq, False))
            if there:
                yield row(REMOVE)
            return
        best = None
        for part in parts:
            for r in part.itertuples():
                own = (int(r.seq), bool(r.removed), r.payload or "", r.payload, r.until)
                best = own if best is None or own[:3] > best[:3] else best
        if seq is None or best[0] > seq:
            was, seq, there = there, best[0], not best[1]
            if there:
                yield row(ENCODE, best[3])
            elif was:
                yield row(REMOVE)
            state.update((seq, there))
            if keep_seconds > 0:
                state.setTimeoutTimestamp(max(int(best[4].timestamp() * 1000), state.getCurrentWatermarkMs() + 1))

    made, kept = "path string, seq long, action string, payload string", "seq long, there boolean"
    until = marked.withColumn("until", F.col("at") + F.make_dt_interval(secs=F.lit(float(keep_seconds))))
    if keep_seconds > 0:  # the watermark of `until` is the time of the newest event
        return until.withWatermark("until", f"{keep_seconds} seconds").groupBy("path").applyInPandasWithState(follow, made, kept, "update", GroupStateTimeout.EventTimeTimeout)
    return until.groupBy("path").applyInPandasWithState(follow, made, kept, "update", GroupStateTimeout.NoTimeout)


def table_of(encoded: T.StructType) -> T.StructType:
    """The schema of the log for an encoder's columns (path among them)."""
    return T.StructType([*MARKS.fields, *[f for f in encoded.fields if f.name not in MARKS.names]])


def follow(events: DataFrame, encode: Callable[[DataFrame], DataFrame], store: Store, checkpoint: str, keep_seconds: int = 0) -> StreamingQuery:
    """Start a stream that keeps `store` (of the schema table_of gives) up to date; encode: (path, payload) to vector rows with
    path. It takes what there is and ends; started again, it goes on where it was."""

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        try:
            made = encode(df.filter(F.col("action") == ENCODE).select("path", "payload")).join(df.select(F.col("path").alias("__p"), "seq"), F.col("path") == F.col("__p")).drop("__p")
            gone = df.filter(F.col("action") == REMOVE).select("path", "seq", F.lit(True).alias("gone"))
            store.append(made.withColumn("gone", F.lit(False)).unionByName(gone, allowMissingColumns=True))
        finally:
            df.unpersist()

    return changes(events, keep_seconds).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(store: Store) -> DataFrame:
    """The rows of the last change of each path that is there; of a batch that ran twice, the second run's."""
    rows = store.rows()
    last = rows.groupBy(F.col("path").alias("__p")).agg(F.max(F.struct("seq", COMMIT)).alias("__last"))
    met = rows.join(last, (F.col("path") == F.col("__p")) & (F.struct("seq", COMMIT) == F.col("__last")))
    return met.filter(~F.col("gone")).select(*[c for c in store.schema.names if c != "gone"])
