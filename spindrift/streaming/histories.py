"""The last turns of each conversation, kept in the state of a stream."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from spindrift.streaming.logs import drained

#: Turns that the history of a conversation holds.
LAST = 6
#: Where the state is kept: the default store has no lists and timers.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _History(StatefulProcessor):
    """One list of turns a conversation, and a timer that forgets it."""

    def __init__(self, last: int, idle: timedelta | None):
        self.last, self.idle_ms = last, None if idle is None else int(idle.total_seconds() * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "turn long, text string")
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timer) -> Iterator[Row]:
        due = [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()] if self.idle_ms is not None else []
        if due and max(due) <= timer.getCurrentWatermarkInMs():  # new rows come before the timer that is due in the same batch
            yield from self._close(key, max(due))
        kept = [tuple(t) for t in self.turns.get()] if self.turns.exists() else []
        n, latest = self.seen.get()[0] if self.seen.exists() else 0, max(due, default=0) - (self.idle_ms or 0)
        for row in rows:
            n += 1
            kept = sorted([*kept, (row["turn"], row["text"])], key=_order)[-self.last :]
            latest = max(latest, row["ts_ms"])
        self.turns.put(kept)
        self.seen.update((n,))
        if self.idle_ms is not None:
            for t in due:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(latest + self.idle_ms)
        yield self._row(key, n, kept, latest, False)

    def handleExpiredTimer(self, key, timer, expired) -> Iterator[Row]:
        yield from self._close(key, expired.getExpiryTimeInMs())

    def _close(self, key, due: int) -> Iterator[Row]:
        kept, n = [tuple(t) for t in self.turns.get()], self.seen.get()[0]
        self.turns.clear()
        self.seen.clear()
        yield self._row(key, n, kept, due - self.idle_ms, True)

    def _row(self, key, n: int, kept: list[tuple], newest: int, closed: bool) -> Row:
        return Row(conv_id=key[0], seen=n, turns=[Row(turn=t, text=x) for t, x in kept], newest=newest, closed=closed)

    def close(self) -> None:
        pass


def _order(turn: tuple) -> tuple:
    return turn[0], turn[1] is not None, turn[1] or ""


def histories(stream: DataFrame, last: int = LAST, idle: timedelta | None = None, late: str = "0 seconds") -> DataFrame:
    """``conv_id, seen, turns, newest, closed``: after each batch, the last turns of the conversations that the batch added to; ``newest`` is the time of its newest row.

    ``stream``: ``conv_id, turn, text``, and ``ts`` if ``idle`` is given. The state of a conversation is ``last`` turns, however long it is; turns may
    come in any order, and of equal ones the smaller text comes first. A conversation that was ``idle`` so long (in event time, ``late`` behind the newest
    row) is given out once more, ``closed``, and forgotten: what it says in a later batch is a new history. Rows without a conversation or turn are left out.
    """
    rows = stream.filter("conv_id is not null and turn is not null")
    if idle is None:
        rows = rows.withColumn("ts_ms", F.lit(0).cast("long"))
    else:
        rows = rows.withWatermark("ts", late).withColumn("ts_ms", F.unix_millis("ts"))
    schema = f"conv_id {stream.schema['conv_id'].dataType.simpleString()}, seen long, turns array<struct<turn: long, text: string>>, newest long, closed boolean"
    return rows.groupBy("conv_id").transformWithState(_History(last, idle), schema, "Append", "None" if idle is None else "EventTime")


def replayed(stream: DataFrame, last: int = LAST, idle: timedelta | None = None, late: str = "0 seconds") -> DataFrame:
    """The histories after all that the stream holds now, as written to the shared folder."""
    conf = stream.sparkSession.conf
    before = {k: conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        conf.set(k, v)
    try:
        return drained(histories(stream, last, idle, late))
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def latest(found: DataFrame) -> DataFrame:
    """``conv_id, turn, text``: the history of each conversation that no timer has closed since."""
    newest = found.groupBy("conv_id").agg(F.max_by(F.struct("turns", "closed"), F.struct("newest", "seen", "closed")).alias("h")).filter("not h.closed")
    return newest.select("conv_id", F.explode("h.turns").alias("t")).select("conv_id", "t.turn", "t.text")
