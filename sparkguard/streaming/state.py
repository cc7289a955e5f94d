"""Stateful processors with timers: what is kept of a caller or a request between batches.

State lives in the RocksDB store, so it may be larger than memory; a batch reads and writes only the keys that it has rows of. Timers run on event
time: a key that gets no rows any more is dropped when the watermark passes its timer, whether or not data come.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

from ..schemas import TURN_SUMMARY

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Processors need this store; streams that were started keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def set_timer(handle, at_ms: int) -> None:
    """The key's only timer."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
    handle.registerTimer(int(at_ms))


class RollingBudget(StatefulProcessor):
    """Verdicts of a caller's requests: per_minute of them are allowed in any 60 s. State: a list of the times of the last minute's allowed ones."""

    def __init__(self, per_minute: int, minute_us: int = 60_000_000):
        self.per_minute, self.minute = per_minute, minute_us

    def init(self, handle) -> None:
        self.handle, self.times = handle, handle.getListState("times", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        recent = deque(sorted(t for (t,) in self.times.get()))
        dropped, added, verdicts = False, [], []
        batch = pd.concat(list(rows)).sort_values(["ts_utc", "id"])
        for r in batch.itertuples():
            now = r.ts_utc.value // 1000
            while recent and recent[0] <= now - self.minute:
                recent.popleft()
                dropped = True
            verdicts.append("block" if len(recent) >= self.per_minute else "allow")
            if verdicts[-1] == "allow":
                recent.append(now)
                added.append((now,))
        if dropped:
            self.times.put([(t,) for t in recent])
        else:  # what is there stays as it is
            for row in added:
                self.times.appendValue(row)
        last = recent[-1] if recent else batch.ts_utc.iloc[-1].value // 1000
        set_timer(self.handle, max(last // 1000, timerValues.getCurrentWatermarkInMs()) + self.minute // 1000)
        yield pd.DataFrame({"caller_id": batch.caller_id, "id": batch.id, "verdict": verdicts})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        return iter(())

    def close(self) -> None:
        pass


ACTIONS = ("allow", "flag", "redact", "block")
TURN = "request_id string, first_ts timestamp, state string, pre_ms double, model_ms double, post_ms double, strength int"


class LiveTurns(StatefulProcessor):
    """Requests folded into their stages: running, failed, blocked or done by the strongest action; one that never ends is abandoned after some minutes.

    The key is a bucket of requests, so that a batch is folded in columns; its state holds the requests that are still open to rows.
    """

    FOLD = {"first": "min", "failed": "max", "reply": "max", "pre": "sum", "model": "sum", "post": "sum", "strength": "max", "until": "max"}

    def __init__(self, minutes: int):
        self.ms = minutes * 60_000

    def init(self, handle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", "turns binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [self._folded(part) for part in rows]
        turns = pd.concat([self._read(), *parts]).groupby("request_id", sort=False).agg(self.FOLD)
        now = turns.index.isin(pd.concat(parts).request_id)
        turns.loc[now, "until"] = turns["first"][now].floordiv(1000).clip(lower=timerValues.getCurrentWatermarkInMs()) + self.ms
        self._write(turns.reset_index())
        yield self._rows(turns[now].reset_index())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        turns = self._read()
        over = turns.until <= timerValues.getCurrentWatermarkInMs()
        self._write(turns[~over])
        left = turns[over & ~(turns.failed | turns.reply | (turns.strength == 3))]
        if len(left):
            yield self._rows(left).assign(state="abandoned")

    def _folded(self, part: pd.DataFrame) -> pd.DataFrame:
        summary, request = part.check == TURN_SUMMARY, part.checkpoint.isin(["input", "tool_result"])
        sums = {n: part[c].where(summary & side, 0.0).fillna(0.0).astype("float64") for n, c, side in (("pre", "overhead_ms", request), ("model", "upstream_latency_ms", ~request), ("post", "overhead_ms", ~request))}
        facts = {"first": part.ts_utc.astype("datetime64[us]").astype("int64"), "failed": part.check == "upstream_unavailable", "reply": summary & ~request, "strength": part.strength.where(summary, 0).fillna(0).astype("int64")}
        return pd.DataFrame({"request_id": part.request_id, **facts, **sums, "until": 0}).groupby("request_id", sort=False, as_index=False).agg(self.FOLD)

    def _rows(self, turns: pd.DataFrame) -> pd.DataFrame:
        state = pd.Series(ACTIONS)[turns.strength].to_numpy()
        state = np.where(turns.failed, "failed", np.where(turns.reply | (turns.strength == 3), state, "running"))
        return pd.DataFrame({"request_id": turns.request_id, "first_ts": pd.to_datetime(turns["first"], unit="us"), "state": state, "pre_ms": turns.pre, "model_ms": turns.model, "post_ms": turns.post, "strength": turns.strength.astype("int32")})

    def _read(self) -> pd.DataFrame | None:
        return pa.ipc.open_stream(bytes(self.open.get()[0])).read_pandas() if self.open.exists() else None

    def _write(self, turns: pd.DataFrame) -> None:
        if not len(turns):
            return self.open.clear()
        table, sink = pa.Table.from_pandas(turns, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.open.update((sink.getvalue().to_pybytes(),))
        set_timer(self.handle, int(turns.until.min()))

    def close(self) -> None:
        pass


def by_key(rows: DataFrame, keys: str | tuple[str, ...], processor: StatefulProcessor, schema: str, mode: str) -> DataFrame:
    use_rocksdb(rows.sparkSession)
    return rows.groupBy(*([keys] if isinstance(keys, str) else keys)).transformWithStateInPandas(processor, schema, mode, "eventTime")
