"""Roll-ups that late rows correct: state per object, revisions out, and a table merged from them.

Nothing is dropped for being late. A processor keeps what it needs per object (sums of recent days, alert days), answers every
batch with revisions of the days or orders that it changed, and the reader takes the newest revision of each. The store is
never read again. Event-time timers close orders and let go the sums of old days; a reading for a day that was let go starts a
further segment of the day, and segments are added up by the reader.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

DAY_MS = 86_400_000
MEANS = ("t_supply", "t_return", "p_supply", "p_return")
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_SUMS = ", ".join(f"{c}_sum double, {c}_n long" for c in MEANS) + ", p_supply_min double, p_supply_max double, n_samples long"
_SUM_NAMES = [part.split()[0] for part in _SUMS.split(", ")]
_NUMBERS = ["segment", "revision", *_SUM_NAMES]  # of one day, as doubles: whole ones are exact below 2^53
_LOW, _HIGH = _NUMBERS.index("p_supply_min"), _NUMBERS.index("p_supply_max")
_COUNTS = ["segment", "revision", *[f"{c}_n" for c in MEANS], "n_samples"]
DAY_REVISIONS = f"object_id string, day int, segment long, revision long, {_SUMS}"
ORDER_REVISIONS = ("object_id string, opened_at int, revision long, last_alert_at int, alerts long, peak_score double, "
                   "open boolean, gone boolean")


def use_state_store(spark: SparkSession) -> None:
    """Timers and maps of state need the state store on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _late_kept(stream: DataFrame, seconds: str, delay: str, *columns: str) -> DataFrame:
    """Columns of the stream, with a watermark by ``seconds`` that moves timers but drops no row."""
    timed = stream.withColumn("event_time", F.timestamp_seconds(seconds)).withWatermark("event_time", delay)
    return timed.select(*columns)


def _most(a, b):
    return b if a is None else a if b is None else max(a, b)


def _number(x):
    return None if pd.isna(x) else float(x)


class DaySums(StatefulProcessor):
    """Sums of every object-day, kept for ``keep_days`` after the watermark has passed the day.

    An object's recent days are one value of state, a table of numbers: a batch reads and writes it once, however many days
    it brings, and one timer waits for the earliest day.
    """

    def __init__(self, keep_days: int):
        self.keep_days = keep_days

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "let_go long, timer long, days binary, sums binary")

    def stored(self) -> tuple[int, int | None, np.ndarray, np.ndarray]:
        """Days let go, the day that the timer waits for, and the recent days with their rows of numbers."""
        kept = self.kept.get()
        if kept is None:
            return 0, None, np.zeros(0, np.int64), np.zeros((0, len(_NUMBERS)))
        days = np.frombuffer(kept[2], np.int64)
        return kept[0], kept[1], days, np.frombuffer(kept[3], np.float64).reshape(len(days), len(_NUMBERS))

    def store(self, let_go: int, timer: int | None, days: np.ndarray, table: np.ndarray) -> None:
        if len(days) and timer != days[0]:
            timer = int(days[0])
            self.handle.registerTimer(self.expires(timer))
        self.kept.update((let_go, timer, days.tobytes(), table.tobytes()))

    def expires(self, day: int) -> int:
        return (day + 1 + self.keep_days) * DAY_MS

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = {c: np.concatenate(parts) for c, parts in _columns(rows).items()}
        found, place = np.unique(batch["ts_recorded"].astype(np.int64) // 86400, return_inverse=True)
        let_go, timer, days, table = self.stored()
        merged = np.union1d(days, found)
        new = np.zeros((len(merged), len(_NUMBERS)))
        new[:, 0] = let_go  # a day not stored starts a segment
        new[:, _LOW], new[:, _HIGH] = np.nan, np.nan
        new[np.searchsorted(merged, days)] = table
        changed = np.searchsorted(merged, found)
        new[changed, 1] += 1
        for i, c in enumerate(MEANS):
            known = ~np.isnan(batch[c])
            new[changed, 2 + 2 * i] += np.bincount(place[known], batch[c][known], len(found))
            new[changed, 3 + 2 * i] += np.bincount(place[known], minlength=len(found))
        at = changed[place]
        for column, pick in ((_LOW, np.fmin), (_HIGH, np.fmax)):
            pick.at(new[:, column], at, batch["p_supply"])
        new[changed, -1] += np.bincount(place, minlength=len(found))
        self.store(let_go, timer, merged, new)
        out = pd.DataFrame(new[changed], columns=_NUMBERS).astype({c: np.int64 for c in _COUNTS})
        out.insert(0, "day", found.astype(np.int32))
        out.insert(0, "object_id", key[0])
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        let_go, timer, days, table = self.stored()
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        stay = self.expires(days) > passed
        if not stay.all():
            self.store(let_go + int((~stay).sum()), timer, days[stay], table[stay])
        yield from ()

    def close(self) -> None:
        pass


def _columns(rows: Iterator[pd.DataFrame]) -> dict[str, list[np.ndarray]]:
    out: dict[str, list[np.ndarray]] = {c: [] for c in ("ts_recorded", *MEANS)}
    for part in rows:
        for c, parts in out.items():
            parts.append(part[c].to_numpy() if c == "ts_recorded" else part[c].to_numpy(np.float64, na_value=np.nan))
    return out


def day_revisions(stream: DataFrame, delay: str = "1 day", keep_days: int = 30) -> DataFrame:
    """A stream of readings to a stream of object-day revisions."""
    use_state_store(stream.sparkSession)
    readings = _late_kept(stream.dropna(subset=["object_id", "ts_recorded"]), "ts_recorded", delay, "object_id", "ts_recorded", *MEANS)
    return readings.groupBy("object_id").transformWithStateInPandas(DaySums(keep_days), DAY_REVISIONS, "Append", "EventTime")


def merged_days(revisions: DataFrame) -> DataFrame:
    """One row per object and day: the newest revision of each segment, segments added up."""
    newest = revisions.groupBy("object_id", "day", "segment").agg(
        F.max_by(F.struct(*_SUM_NAMES), "revision").alias("r")).select("object_id", "day", "r.*")
    means = [F.try_divide(F.sum(f"{c}_sum"), F.sum(f"{c}_n")).alias(f"{c}_mean") for c in MEANS]
    return newest.groupBy("object_id", F.date_from_unix_date("day").alias("date")).agg(
        *means, F.min("p_supply_min").alias("p_supply_min"), F.max("p_supply_max").alias("p_supply_max"),
        F.sum("n_samples").alias("n_samples"))


class Orders(StatefulProcessor):
    """Alert days of every object; an order is a run of them with gaps of at most the cooldown."""

    def __init__(self, cooldown_days: int):
        self.cooldown = cooldown_days

    def init(self, handle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day int", "alerts long, peak double")
        self.revision = handle.getValueState("revision", "n long")

    def orders(self, days: dict[int, tuple]) -> dict[int, tuple]:
        """First day of each order to its last day, alerts and peak."""
        found: dict[int, tuple] = {}
        first = last = None
        for day in sorted(days):
            alerts, peak = days[day]
            if last is None or day - last > self.cooldown:
                first = day
                found[first] = (day, alerts, peak)
            else:
                _, n, high = found[first]
                found[first] = (day, n + alerts, _most(high, peak))
            last = day
        return found

    def closes_at(self, last: int) -> int:
        return (last + self.cooldown + 1) * DAY_MS

    def revised(self, key, changes: list[tuple]) -> pd.DataFrame:
        turn = self.revision.get()
        turn = (turn[0] if turn else 0) + 1
        self.revision.update((turn,))
        return pd.DataFrame([(key[0], first, turn, *rest) for first, *rest in changes],
                            columns=[part.split()[0] for part in ORDER_REVISIONS.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        found = batch.groupby("day")["score"].agg(["size", "max"])
        days = {k[0]: tuple(v) for k, v in self.days.iterator()}
        before = self.orders(days)
        for day, n, peak in found.itertuples():
            old = days.get(day, (0, None))
            days[day] = (old[0] + int(n), _most(old[1], _number(peak)))
            self.days.updateValue((int(day),), days[day])
        after = self.orders(days)
        now = timerValues.getCurrentWatermarkInMs()
        changes = [(first, before[first][0], 0, None, False, True) for first in before if first not in after]
        for first, order in after.items():
            if before.get(first) != order:
                is_open = now < self.closes_at(order[0])
                changes.append((first, *order, is_open, False))
                if is_open:
                    self.handle.registerTimer(self.closes_at(order[0]))
        yield self.revised(key, changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        orders = self.orders({k[0]: tuple(v) for k, v in self.days.iterator()})
        closed = [(first, *order, False, False) for first, order in orders.items() if self.closes_at(order[0]) == at]
        if closed:
            yield self.revised(key, closed)

    def close(self) -> None:
        pass


def order_revisions(alerts: DataFrame, cooldown_days: int, delay: str = "1 day") -> DataFrame:
    """A stream of alerts (object_id, event_time, score) to a stream of order revisions, open orders included."""
    use_state_store(alerts.sparkSession)
    timed = alerts.dropna(subset=["object_id", "event_time"]).withColumn("_second", F.unix_seconds("event_time"))
    daily = timed.withColumn("day", F.unix_date(F.col("event_time").cast("date")))
    return _late_kept(daily.drop("event_time"), "_second", delay, "object_id", "day", "score").groupBy(
        "object_id").transformWithStateInPandas(Orders(cooldown_days), ORDER_REVISIONS, "Append", "EventTime")


def merged_orders(revisions: DataFrame) -> DataFrame:
    """Orders as they are now: the newest revision of each first day that is not gone, with whether it is still open."""
    newest = revisions.groupBy("object_id", "opened_at").agg(
        F.max_by(F.struct("last_alert_at", "alerts", "peak_score", "open", "gone"), "revision").alias("r"))
    day = F.date_from_unix_date
    return newest.where("NOT r.gone").select(
        "object_id", day("opened_at").alias("opened_at"), day("r.last_alert_at").alias("last_alert_at"), "r.alerts", "r.peak_score",
        "r.open")
