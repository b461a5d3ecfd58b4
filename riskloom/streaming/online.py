"""The same features on a stream.

Two keyed stateful operators keep what the windows look at in batch: one per client, one per shared
entity. They only maintain state and emit the ``h_*`` columns of the batch pass, so the feature
formulas exist once, in the batch operators. Each query writes a table keyed by tx_id; readers join
the two.

Events of a key are expected in time order. A row older than the last one of its key is emitted with
``late`` set and leaves the state alone; rows behind the watermark (``lateness`` after the newest event) are not emitted. The next batch run includes both.

What a window looks at leaves the state by itself: every update sets an event-time timer to the moment the key's last event leaves its longest window, and when the
watermark passes it the key's window rows are cleared. What has no window (totals, first sightings) stays.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskloom.operators.client_features import FAMILIES, client_features
from riskloom.operators.entity_features import KINDS, WEEK_US, _entity
from riskloom.sources.transactions import DAY_US, HOUR_US, normalise, with_place, with_profile

INPUT = ["tx_id", "us", "timestamp", "client_id", "amount", "merchant_category", "channel", "tx_type", "device_id",
         "ip", "city", "country", "is_vpn", "remote_access", "call_minutes_before", "session_duration_s",
         "recipient_id", "lat", "lon"]
STATE_COLUMNS = ("h_n long, h_sum double, h_sq double, h_max double, h_night long, h_1h long, h_24h long, "
                 "h_money_24h double, prev_us long, prev_lat double, prev_lon double, "
                 + ", ".join(f"h_n_{f} long, h_first_{f} long" for f in FAMILIES) + ", late boolean")
COUNTERS = ("tx_id {tx}, kind string, us long, r_total long, r_day long, r_week long, r_count long, "
            "r_money double, r_first long, late boolean")


UNIT = Decimal("0.0001")
LATENESS = "1 day"


def _units(amount: float) -> int:
    """An amount in ten thousandths, so that sums of amounts that come and go stay exact."""
    return int(Decimal(repr(float(amount))).quantize(UNIT, ROUND_HALF_UP).scaleb(4))


def _wake(handle: StatefulProcessorHandle, us: int) -> None:
    """One timer per key: when an event of this moment has left the window."""
    for at in list(handle.listTimers()):
        handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
    handle.registerTimer(us // 1000 + 1)


def _rows(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(["us", "tx_id"], kind="stable")


class ClientHistory(StatefulProcessor):
    """Totals, last position, last day's amounts and sightings per value of one client."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState(
            "totals", "n long, sum double, sq double, mx double, night long, us long, lat double, lon double")
        self.handle = handle
        self.recent = handle.getListState("recent", "us long, units long")
        self.seen = handle.getMapState("seen", "family string, value string", "n long, first long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _rows(rows)
        n, total, sq, mx, night, last, lat, lon = self.totals.get() if self.totals.exists() else (0, 0.0, 0.0, 0.0, 0, None, None, None)
        recent = deque(self.recent.get()) if self.recent.exists() else deque()
        known: dict = {}

        def sightings(k):
            if k not in known:
                known[k] = self.seen.getValue(k) if self.seen.containsKey(k) else (0, None)
            return known[k]

        changed, out = set(), []
        units = sum(m for _, m in recent)  # once per micro-batch, then kept up
        hour = deque(t for t, _ in recent)
        for r in pdf.to_dict("records"):
            us, amount = r["us"], r["amount"]
            late = last is not None and us < last
            while not late and recent and recent[0][0] < us - DAY_US:
                units -= recent.popleft()[1]
            while not late and hour and hour[0] < us - HOUR_US:
                hour.popleft()
            row = [n, total, sq, mx, night, len(hour), len(recent), units / 10_000, last, lat, lon]
            for fam, col in FAMILIES.items():
                row += list(sightings((fam, str(r[col]))))
            out.append((*[r[c] for c in pdf.columns], *row, late))
            if late:
                continue
            n, total, sq, mx = n + 1, total + amount, sq + amount * amount, max(mx, amount)
            night += int(r["timestamp"].hour < 6)
            last, lat, lon = us, r["lat"], r["lon"]
            recent.append((us, _units(amount)))
            units += recent[-1][1]
            hour.append(us)
            for fam, col in FAMILIES.items():
                k = (fam, str(r[col]))
                c, first = sightings(k)
                known[k] = (c + 1, us if first is None else first)
                changed.add(k)
        self.totals.update((n, total, sq, mx, night, last, lat, lon))
        if recent:
            self.recent.put(list(recent))
            _wake(self.handle, last + DAY_US)
        else:
            self.recent.clear()
        for k in changed:
            self.seen.updateValue(k, known[k])
        names = [f.split()[0] for f in STATE_COLUMNS.split(", ")]
        res = pd.DataFrame(out, columns=[*pdf.columns, *names])
        yield res.astype({c: "Int64" for c in res.columns if c.startswith(("h_first", "prev_us"))})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        return iter(())

    def close(self) -> None:
        pass


class EntityHistory(StatefulProcessor):
    """Clients ever seen and the last week's sightings of one device, address or recipient."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "clients long, first long, last long")
        self.handle = handle
        self.recent = handle.getListState("recent", "us long, client string, units long")
        self.clients = handle.getMapState("clients", "client string", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _rows(rows)
        clients, first, last = self.totals.get() if self.totals.exists() else (0, None, None)
        week = deque(self.recent.get()) if self.recent.exists() else deque()
        day = deque()
        in_week, in_day, units = Counter(c for _, c, _ in week), Counter(), 0
        started, fresh, out = False, set(), []
        keep = WEEK_US if pdf["kind"].iloc[0] == "recipient" else DAY_US
        for r in pdf.to_dict("records"):
            us, client = r["us"], str(r["client_id"])
            if not started:  # the last day's part of the stored week
                day = deque(x for x in week if x[0] >= us - DAY_US)
                in_day, units, started = Counter(c for _, c, _ in day), sum(m for _, _, m in day), True
            late = last is not None and us < last
            if not late:
                while week and week[0][0] < us - keep:
                    _drop(in_week, week.popleft()[1])
                while day and day[0][0] < us - DAY_US:
                    _, c, m = day.popleft()
                    _drop(in_day, c)
                    units -= m
            out.append((r["tx_id"], r["kind"], us, clients, len(in_day), len(in_week), len(day), units / 10_000, first, late))
            if late:
                continue
            if client not in fresh and not self.clients.containsKey((client,)):
                fresh.add(client)
                clients += 1
            first, last = (us if first is None else first), us
            for q, counter in ((week, in_week), (day, in_day)):
                q.append((us, client, _units(r["amount"])))
                counter[client] += 1
            units += week[-1][2]
        self.totals.update((clients, first, last))
        if week:
            self.recent.put(list(week))
            _wake(self.handle, last + keep)
        else:
            self.recent.clear()
        for c in fresh:
            self.clients.updateValue((c,), (1,))
        names = [f.split()[0] for f in COUNTERS.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({"r_first": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        return iter(())

    def close(self) -> None:
        pass


def _drop(counter: Counter, client: str) -> None:
    counter[client] -= 1
    if counter[client] == 0:
        del counter[client]


def _watermarked(tx: DataFrame, lateness: str) -> DataFrame:
    return tx.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", lateness)


def stream_client_features(tx: DataFrame, profiles: DataFrame, places: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Streaming transactions to streaming client features; profiles and places are static tables."""
    d = with_place(normalise(_watermarked(tx, lateness)).drop("lat", "lon"), places).select(*INPUT)
    schema = T.StructType(d.schema.fields + T._parse_datatype_string(STATE_COLUMNS).fields)
    s = d.groupBy("client_id").transformWithStateInPandas(ClientHistory(), schema, "Append", "EventTime")
    s = s.withColumn("h_prev", F.when(F.col("prev_us").isNotNull(), F.struct(
        F.col("prev_us").alias("us"), F.col("prev_lat").alias("lat"), F.col("prev_lon").alias("lon"))))
    s = with_place(with_profile(s.drop("prev_us", "prev_lat", "prev_lon"), profiles), places, "home_city", "home_lat", "home_lon")
    return client_features(s)


def stream_entity_counters(tx: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Streaming transactions to one row of counters per (transaction, entity)."""
    d = normalise(_watermarked(tx, lateness))
    e = F.explode(F.filter(F.array(*[
        F.when(F.col(c) != "", F.struct(F.lit(k).alias("kind"), _entity(k).alias("ent"))) for k, c in KINDS.items()]),
        lambda x: x.isNotNull())).alias("e")
    d = d.select("tx_id", "us", "timestamp", F.col("client_id").cast("string").alias("client_id"), "amount", e).select(
        "tx_id", "us", "timestamp", "client_id", "amount", "e.kind", "e.ent")
    tx_type = dict(d.dtypes)["tx_id"]
    return d.groupBy("ent").transformWithStateInPandas(
        EntityHistory(), COUNTERS.format(tx=tx_type), "Append", "EventTime")


def append_to(path: str):
    """A ``foreachBatch`` sink that adds each micro-batch to a Parquet table once, also on a retry."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
