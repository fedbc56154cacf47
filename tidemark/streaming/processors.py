"""Per-key state of the streaming operators.

Rows wait in a list of their key until the watermark has passed them; an event-time timer set to the earliest one
then releases all that lie at or before the watermark, and they are stepped through in the order of time and, where the stream
has one, sequence. So rows may come in any order within the delay of the watermark and a replay still equals the batch
operators. Only rows behind what was released, and repeated rows, are dropped and counted in the output.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What the processors call the event time in microseconds.
MICROS = "event_micros"
#: Rows that are Python objects at a time; all others of a key are packed numbers, 8 bytes each.
BATCH = 8192


def missing(x) -> bool:
    """Whether a number is absent: NULL, NaN or infinite."""
    return x is None or not math.isfinite(x)


class OrderedProcessor(StatefulProcessor):
    """Feeds a key's rows in time order to ``step`` and stores its state."""

    def __init__(self, key: str, ts: str, columns: list[str], outputs: list[str], initial: list[float], seq: str | None = None):
        self.key, self.ts, self.columns, self.outputs, self.initial, self.seq = key, ts, columns, outputs, initial, seq

    def init(self, handle: StatefulProcessorHandle) -> None:
        number = lambda c: T.StructField(c, T.DoubleType())
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType([
            T.StructField("at", T.LongType()), T.StructField("place", T.LongType()), *map(number, self.columns)]))
        self.state = handle.getValueState("track", T.StructType([
            T.StructField("last", T.LongType()), T.StructField("place", T.LongType()), T.StructField("dropped", T.LongType()),
            T.StructField("alarm", T.LongType()), T.StructField("numbers", T.ArrayType(T.DoubleType())), T.StructField("window", T.ArrayType(T.DoubleType()))]))

    def step(self, numbers: list, window: list, row: tuple) -> tuple:
        raise NotImplementedError

    def _track(self) -> list:
        """Last time and sequence released, rows dropped, the timer that is set, and what ``step`` keeps."""
        stored = self.state.get() if self.state.exists() else None
        return list(stored) if stored else [None, 0, 0, None, list(self.initial), []]

    def _wake(self, track: list, micros: int) -> None:
        """Sets the one timer of the key to the end of the millisecond of ``micros``."""
        alarm = -(-micros // 1000)
        if track[3] is not None:
            self.handle.deleteTimer(track[3])
        self.handle.registerTimer(alarm)
        track[3] = alarm

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        track, first = self._track(), None
        for batch in rows:
            places = batch[self.seq].tolist() if self.seq else [0] * len(batch)
            # pandas shows a missing number as NaN; either way it is absent.
            values = [[None if pd.isna(x) else float(x) for x in batch[c].tolist()] for c in self.columns]
            kept = []
            for at, place, *row in zip(batch[MICROS].tolist(), places, *values):
                if track[0] is not None and (at, place) <= (track[0], track[1]):
                    track[2] += 1
                    continue
                kept.append((int(at), int(place), *row))
                first = at if first is None else min(first, at)
            if kept:
                self.waiting.appendList(kept)
        if first is not None and (track[3] is None or -(-first // 1000) < track[3]):
            self._wake(track, int(first))
        self.state.update(tuple(track))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        track, passed = self._track(), timerValues.getCurrentWatermarkInMs() * 1000
        track[3] = None
        numbers, rest = self._drained(passed)
        first = True
        for i in range(0, len(rest), BATCH):
            rows = self._rows(rest[i:i + BATCH])
            (self.waiting.put if first else self.waiting.appendList)(rows)
            first = False
        if first:
            self.waiting.clear()
        else:
            self._wake(track, int(rest["at"].min()))
        del rest
        # Lists end with the missing numbers; sorts are stable, so equal rows stay as they came.
        order = np.lexsort([numbers[name] for name in reversed(numbers.dtype.names)])
        for i in range(0, len(order), BATCH):
            out = []
            for at, place, *row in self._rows(numbers[order[i:i + BATCH]]):
                if track[0] is not None and (at, place) <= (track[0], track[1]):
                    track[2] += 1
                else:
                    track[0], track[1] = at, place
                    out.append((key[0], pd.Timestamp(at, unit="us"), *([place] if self.seq else []), *self.step(track[4], track[5], tuple(row)), track[2]))
            if out:
                yield pd.DataFrame(out, columns=[self.key, self.ts, *([self.seq] if self.seq else []), *self.outputs, "late_dropped"])
        self.state.update(tuple(track))

    def _drained(self, passed: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows up to ``passed``, later rows) of the waiting list as packed numbers, a missing one as NaN."""
        kind = np.dtype([("at", np.int64), ("place", np.int64), *((c, np.float64) for c in self.columns)])
        parts, later = [np.zeros(0, kind)], [np.zeros(0, kind)]
        rows = iter(self.waiting.get())
        while some := list(islice(rows, BATCH)):
            part = np.empty(len(some), kind)
            for name, values in zip(kind.names, zip(*some)):
                part[name] = [np.nan if x is None else x for x in values] if name in self.columns else values
            due = part["at"] <= passed
            parts.append(part[due])
            later.append(part[~due])
        return np.concatenate(parts), np.concatenate(later)

    @staticmethod
    def _rows(part: np.ndarray) -> list[tuple]:
        """Rows of packed numbers as Python numbers."""
        return [(at, place, *(None if x != x else x for x in row)) for at, place, *row in part.tolist()]

    def close(self) -> None:
        pass


def _ema(numbers: list, at: int, x: float, period: int) -> float:
    """EMA in two slots: value and whether it has been seeded."""
    alpha = 2.0 / (period + 1)
    numbers[at] = alpha * x + (1 - alpha) * numbers[at] if numbers[at + 1] else x
    numbers[at + 1] = 1.0
    return numbers[at]


class IndicatorProcessor(OrderedProcessor):
    """SMA, EMA, RSI, Bollinger, MACD and ATR of one bar stream.

    Slots: 0-1 previous close and its flag, 2-4 RSI count and averages, 5-6 EMA,
    7-8 and 9-10 fast and slow, 11-12 signal, 13-14 true range, 15-16 close of the
    last whole bar and its flag. The window holds the latest closes for the
    row-frame indicators. A bar without a finite close is a gap to the recurrences,
    one without all three prices to the true range.
    """

    def __init__(self, key: str, ts: str, sma: int, ema: int, rsi: int, bollinger: tuple, macd: tuple, atr: int):
        outputs = [f"sma_{sma}", f"ema_{ema}", f"rsi_{rsi}", "bb_middle", "bb_upper", "bb_lower", "bb_width",
                   "macd_line", "macd_signal", "macd_histogram", f"atr_{atr}"]
        super().__init__(key, ts, ["close", "high", "low"], outputs, [0.0] * 17)
        self.p = (sma, ema, rsi, bollinger, macd, atr)

    def step(self, s: list, window: list, row: tuple) -> tuple:
        close, high, low = row
        n_sma, n_ema, n_rsi, (n_bb, k_bb), (fast, slow, signal), n_atr = self.p
        window.append(close)
        del window[:-max(n_sma, n_bb)]
        sma, bands = None, (None,) * 4
        if len(window) >= n_sma and None not in window[-n_sma:]:
            sma = sum(window[-n_sma:]) / n_sma
        if len(window) >= n_bb and None not in window[-n_bb:]:
            last = window[-n_bb:]
            mean = sum(last) / n_bb
            dev = k_bb * math.sqrt(sum((x - mean) ** 2 for x in last) / n_bb)
            bands = (mean, mean + dev, mean - dev, 2 * dev)
        atr = None
        if not any(map(missing, row)):
            if s[16]:
                atr = _ema(s, 13, max(high - low, abs(high - s[15]), abs(low - s[15])), n_atr)
            s[15], s[16] = close, 1.0
        if missing(close):
            return (sma, None, None, *bands, None, None, None, atr)
        ema = _ema(s, 5, close, n_ema)
        rsi = 0.0
        if s[1]:
            move = close - s[0]
            gain, loss = max(move, 0.0), max(-move, 0.0)
            s[2] += 1
            if s[2] <= n_rsi:  # slots hold sums until seeded
                s[3], s[4] = s[3] + gain / n_rsi, s[4] + loss / n_rsi
            else:
                s[3] = (s[3] * (n_rsi - 1) + gain) / n_rsi
                s[4] = (s[4] * (n_rsi - 1) + loss) / n_rsi
            if s[2] < n_rsi or (s[3] == 0 and s[4] == 0):
                rsi = 50.0
            else:
                rsi = 100.0 if s[4] == 0 else 100.0 - 100.0 / (1.0 + s[3] / s[4])
        s[0], s[1] = close, 1.0
        line = _ema(s, 7, close, fast) - _ema(s, 9, close, slow)
        sig = _ema(s, 11, line, signal)
        return (sma, ema, rsi, *bands, line, sig, line - sig, atr)


class HysteresisProcessor(OrderedProcessor):
    """Slots: EMA and its flag, bars above, bars below, in position."""

    def __init__(self, key: str, ts: str, lookback: int, period: int, upper: float, lower: float, bars: int):
        super().__init__(key, ts, ["close"],
                         ["momentum", "ema", "bars_above", "bars_below", "action", "confidence"], [0.0] * 5)
        self.p = (lookback, period, upper, lower, bars)

    def step(self, s: list, window: list, row: tuple) -> tuple:
        lookback, period, upper, lower, bars = self.p
        if missing(row[0]):
            return (None,) * 6
        window.append(row[0])
        del window[:-(lookback + 1)]
        if len(window) <= lookback or window[0] <= 0:
            return (None,) * 6
        momentum = row[0] / window[0] - 1
        ema = _ema(s, 0, momentum, period)
        s[2] = s[2] + 1 if ema > upper else 0.0
        s[3] = s[3] + 1 if ema < lower else 0.0
        action = confidence = None
        if s[2] >= bars and not s[4]:
            action, confidence, s[4] = "enter", min(1.0, ema / (upper * 2)), 1.0
        elif s[3] >= bars and s[4]:
            action, confidence, s[4] = "exit", min(1.0, abs(ema) / (abs(lower) * 2)), 0.0
        return (momentum, ema, int(s[2]), int(s[3]), action, confidence)


class PositionProcessor(OrderedProcessor):
    """Slots: quantity, average entry, realised total."""

    def __init__(self, key: str, ts: str, seq: str | None):
        super().__init__(key, ts, ["price", "signed"], ["quantity", "avg_entry", "realized", "realized_total"],
                         [0.0] * 3, seq)

    def step(self, s: list, window: list, row: tuple) -> tuple:
        price, signed = row
        if price is None or signed is None:  # no fill: the book stays as it is
            return (s[0], s[1] if s[0] else None, None, s[2])
        held, cost = s[0], s[1]
        after = held + signed
        realized = 0.0
        if held == 0 or (held > 0) == (signed > 0):
            cost = (cost * abs(held) + price * abs(signed)) / abs(after) if held else price
        else:
            realized = (price - cost) * min(abs(signed), abs(held)) * (1 if held > 0 else -1)
            if after and (after > 0) != (held > 0):
                cost = price
        s[0], s[1], s[2] = after, cost if after else 0.0, s[2] + realized
        return (after, cost if after else None, realized, s[2])
