"""Running totals of a stream, one row per trade, in the order of the trades."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.errors import ConfigurationError
from barloom.streaming.events import market_time

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_FIELDS = ["timestamp", "sequence_number", "price", "size"]
# A symbol's day is forgotten so long after its last trade.
_DAY_OVER_MS = 36 * 3600 * 1000

LAYOUT = ("symbol STRING, trade_date DATE, timestamp BIGINT, sequence_number BIGINT, price DOUBLE, size BIGINT, "
          "accumulated_volume BIGINT, aggregate_vwap DOUBLE")


def running_vwap(trades: DataFrame) -> DataFrame:
    """Each trade with its symbol's volume and VWAP of the market day so far (``accumulated_volume``, ``aggregate_vwap``).

    ``trades`` carry a watermark on ``event_time``. A trade waits until the
    watermark has passed it, so that trades which arrive out of order within the
    delay are still added in order of time and sequence; it is then given once.
    Trades that the watermark has passed before they come are left out;
    :func:`barloom.streaming.sinks.late_rows` keeps them. NULL prices and sizes
    add nothing. The session's state store must be RocksDB.
    """
    if trades.sparkSession.conf.get(_PROVIDER, "") != ROCKS:
        raise ConfigurationError(f"running totals need {_PROVIDER} = {ROCKS}")
    keyed = trades.select("symbol", F.to_date(market_time("event_time")).alias("trade_date"), *[
        F.col(c).cast(t) for c, t in zip(_FIELDS, ("bigint", "bigint", "double", "bigint"))], "event_time").where("event_time IS NOT NULL")
    return keyed.groupBy("symbol", "trade_date").transformWithStateInPandas(
        RunningTotals(), LAYOUT, "Append", "EventTime")


class RunningTotals(StatefulProcessor):
    """Trades of a symbol's day: those that wait, and the totals of those that were given."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows BINARY")
        self.totals = handle.getValueState("totals", "volume BIGINT, value DOUBLE, last BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """Trades wait as one packed piece per input frame; a timer at its last trade releases them."""
        mark = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            # Spark itself lets rows pass that are behind this watermark but not behind the one before.
            frame = frame[frame["timestamp"] > mark]
            if len(frame):
                self.waiting.appendValue((_packed(frame[_FIELDS]),))
                self.handle.registerTimer(int(frame["timestamp"].max()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        pieces = [_unpacked(bytes(data)) for (data,) in self.waiting.get()]
        volume, value, last = self.totals.get() if self.totals.exists() else (0, 0.0, 0)
        if not pieces:
            if mark >= last + _DAY_OVER_MS:
                self.totals.clear()
            return
        held = pd.concat(pieces, ignore_index=True)
        due = (held["timestamp"] <= mark).to_numpy(bool)
        out = held[due].sort_values(["timestamp", "sequence_number"], kind="stable", ignore_index=True)
        if due.all():
            self.waiting.clear()
        elif due.any():
            self.waiting.put([(_packed(held[~due]),)])
        if not len(out):
            return
        size = out["size"].fillna(0).astype("int64").to_numpy()
        worth = (out["price"] * out["size"].astype("Float64")).fillna(0.0).to_numpy("float64")
        volumes = volume + np.cumsum(size)
        # The running sum goes on from the last value, in the order of the trades.
        values = np.cumsum(np.concatenate(([value], worth)))[1:]
        last = int(out["timestamp"].iloc[-1])
        self.totals.update((int(volumes[-1]), float(values[-1]), last))
        self.handle.registerTimer(last + _DAY_OVER_MS)
        with np.errstate(divide="ignore", invalid="ignore"):
            vwap = np.where(volumes != 0, values / volumes, np.nan)
        yield pd.DataFrame({
            "symbol": [key[0]] * len(out), "trade_date": [key[1]] * len(out), **{c: out[c] for c in _FIELDS},
            "accumulated_volume": volumes, "aggregate_vwap": pd.Series(vwap).where(volumes != 0, None)})

    def close(self) -> None:
        pass


_PACKED = pa.schema([("timestamp", pa.int64()), ("sequence_number", pa.int64()), ("price", pa.float64()), ("size", pa.int64())])


def _packed(frame: pd.DataFrame) -> bytes:
    return pa.RecordBatch.from_pandas(frame, schema=_PACKED, preserve_index=False).serialize().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.read_record_batch(pa.py_buffer(data), _PACKED).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
