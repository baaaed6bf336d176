"""A feed of documents: a snapshot first, then what changed, and what has stalled.

delta() compares two snapshots as tables. changes() is the stream: states of documents come in, and
only those go out that differ from the document's last one, by a fingerprint of the watched columns.
State is one typed row for each document, dealt by its id; it can begin as a snapshot's (the feed's first
tick), of which nothing goes out. A document whose work is open and that isn't heard of for a while is
reported as stalled: by a timer if it stays silent, or when it is heard of again too late.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGES = "id bigint, version bigint, kind string, fingerprint bigint"
#: A document's state as it is kept; told: that it has stalled was reported.
STATE = T.StructType([*(T.StructField(c, T.LongType()) for c in ("version", "fingerprint")), *(T.StructField(c, T.BooleanType()) for c in ("deleted", "open")), T.StructField("at", T.LongType()), T.StructField("told", T.BooleanType())])
State = namedtuple("State", STATE.fieldNames())
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def mark(*watched: str) -> Column:
    """Fingerprint of the watched columns; a null differs from an empty value."""
    return F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in watched])


def delta(before: DataFrame, now: DataFrame, key: str, watched: list[str]) -> DataFrame:
    """(key, kind): added, changed or removed between two snapshots; unchanged rows are left out."""
    side = lambda df, name: df.select(key, mark(*watched).alias(name))
    both = side(before, "was").join(side(now, "is"), key, "full_outer")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return both.select(key, kind.alias("kind")).filter("kind IS NOT NULL")


class Changes(StatefulProcessor):
    """One document's last state, and a timer while its work is open. Times are milliseconds."""

    def __init__(self, stall_after_ms: int):
        self.limit = stall_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getValueState("seen", STATE)

    def _keep(self, row, told: bool = False) -> None:
        self.seen.update((row.version, row.fingerprint, row.deleted, row.open, row.at, told))

    def _watch(self, row) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if row.open and not row.deleted:
            self.handle.registerTimer(row.at + self.limit)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._keep(initialState)
        self._watch(initialState)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, out = (State(*self.seen.get()) if self.seen.exists() else None), []
        now = last
        # versions decide the order of what came in one micro-batch
        for row in sorted(rows, key=lambda r: r.version):
            if now is not None and row.version <= now.version:
                continue  # late or repeated
            if now is not None and now.open and not now.deleted and not now.told and row.at - now.at > self.limit:
                out.append((now.version, "stalled", now.fingerprint))
            if row.deleted:
                kind = "removed" if now is not None and not now.deleted else None
            elif now is None or now.deleted:
                kind = "added"
            else:
                kind = "changed" if row.fingerprint != now.fingerprint else None
            if kind:
                out.append((row.version, kind, row.fingerprint))
            now = State(row.version, row.fingerprint, row.deleted, row.open, row.at, False)
        if now is not None and now is not last:
            self._keep(now)
            self._watch(now)
        for version, kind, fingerprint in out:
            yield Row(id=key[0], version=version, kind=kind, fingerprint=fingerprint)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = State(*self.seen.get())
        if now.open and not now.deleted and not now.told:
            self._keep(now, told=True)
            yield Row(id=key[0], version=now.version, kind="stalled", fingerprint=now.fingerprint)

    def close(self) -> None:
        pass


def changes(states: DataFrame, *, stall_after_ms: int = 900_000, delay: str = "1 second", first: DataFrame | None = None) -> DataFrame:
    """CHANGES of a stream of (id, version, fingerprint, deleted, open, ts).

    Repeated and late versions change nothing; a removed document's version stays in the state. first:
    a snapshot with the same columns, from which the states begin. Timers follow the stream's own time.
    """
    states.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # the one that keeps typed state and timers
    timed = lambda df: df.withColumn("at", F.unix_millis("ts"))
    known = timed(first).select("id", "version", "fingerprint", "deleted", "open", "at").groupBy("id") if first is not None else None
    return timed(states).withWatermark("ts", delay).groupBy("id").transformWithState(Changes(stall_after_ms), T.StructType.fromDDL(CHANGES), "Append", "EventTime", initialState=known)


def replayed(ticks: list[DataFrame], path: str) -> DataFrame:
    """A stream of the tables' rows, a table after another: each is written as one set of files, and files are read in the order of their writing."""
    spark: SparkSession = ticks[0].sparkSession
    for k, rows in enumerate(ticks):
        rows.write.parquet(f"{path}/tick={k}")
    return spark.readStream.schema(ticks[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def arriving(ticks: list[DataFrame], path: str) -> Iterator[DataFrame]:
    """The same with a tick's files, however many, in one micro-batch: after each tick is written, the stream is given to be run to its end (with the same progress each time)."""
    spark: SparkSession = ticks[0].sparkSession
    for k, rows in enumerate(ticks):
        rows.write.parquet(f"{path}/tick={k}")
        yield spark.readStream.schema(ticks[0].schema).parquet(f"{path}/*")


def stalled(jobs: DataFrame, now: Column, after_seconds: int = 900) -> DataFrame:
    """jobs with `stalled`: running or queued, and without an update for longer than after_seconds."""
    idle = now.cast("double") - F.col("updated_at").cast("double") > after_seconds
    return jobs.withColumn("stalled", F.coalesce(F.col("status").isin("QUEUED", "RUNNING") & idle, F.lit(False)))
