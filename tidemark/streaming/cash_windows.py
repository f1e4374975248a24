"""The windowed cash rules as a stateful stream that must flag exactly what batch flags.

Windows end at deposits, not on a grid, so the state of an entity is its recent inbound cash. A new deposit re-evaluates
every window that it can belong to; a late one within the watermark joins all of its windows. An alert's key names its
window, so a sink that keeps the fullest alert per key can take the same alert again.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import RuleConfig

EVENT = "transaction_id string, entity_id string, txn_epoch long, amount_cents long, direction string, is_cash int"
ALERT = "key string, rule string, entity_id string, window_start long, window_end long, total_cents long, members array<string>"
STATE = "epochs array<long>, ids array<string>, cents array<long>"


@dataclass(frozen=True)
class StreamRule:
    """A rule on inbound cash: which amounts count, how long its window is, and when a window qualifies."""

    code: str
    window: int
    low: int
    high: int
    least_count: int = 1
    least_total: int = 0

    def counts(self, cents: int) -> bool:
        return self.low <= cents <= self.high

    def qualifies(self, cents: list[int]) -> bool:
        return len(cents) >= self.least_count and sum(cents) >= self.least_total


def stream_rules(cfg: RuleConfig) -> list[StreamRule]:
    return [
        StreamRule("R1_STRUCTURING", cfg.r1_window, cfg.r1_floor, cfg.r1_ceiling, least_count=cfg.r1_deposits),
        StreamRule("LCTR_24H", cfg.cash_window, 1, 2**62, least_total=cfg.cash_total),
    ]


def windows_at(deposits: list[tuple[int, str, int]], rule: StreamRule, since: set[int]) -> Iterator[tuple[int, int, int, list[str]]]:
    """(start, end, total, ids) of the qualifying windows that end at a deposit and hold one of the times in `since`.
    deposits: (epoch, id, cents) in order; deposits at one time share a window."""
    own = [d for d in deposits if rule.counts(d[2])]
    times = [d[0] for d in own]
    for end in sorted(set(times)):
        if not any(end - rule.window <= t <= end for t in since):
            continue
        part = own[bisect.bisect_left(times, end - rule.window) : bisect.bisect_right(times, end)]
        if rule.qualifies([d[2] for d in part]):
            yield part[0][0], end, sum(d[2] for d in part), [d[1] for d in part]


def from_json(raw: DataFrame, column: str = "value") -> DataFrame:
    """Events of JSON messages (Kafka values and the like); what cannot be parsed is dropped."""
    return raw.select(F.from_json(F.col(column).cast("string"), EVENT).alias("e")).where("e.transaction_id IS NOT NULL").select("e.*")


def to_json(alerts: DataFrame) -> DataFrame:
    """key and value of alerts as messages."""
    return alerts.select("key", F.to_json(F.struct(*alerts.columns)).alias("value"))


def kafka_source(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Events of a Kafka topic. The connector's package has to be on the session's class path."""
    return from_json(spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load())


def alerts(events: DataFrame, cfg: RuleConfig | None = None) -> DataFrame:
    """Alerts of a stream of events. Events later than the watermark are dropped, repeated ids count once.

    The watermark advances on every event, so candidates are chosen inside the stateful step and not by a filter before it.
    """
    cfg = cfg or RuleConfig()
    rules = stream_rules(cfg)
    keep = max(r.window for r in rules)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in zip(*state.get, strict=True)] if state.exists else []
        mark = state.getCurrentWatermarkMs() // 1000
        if not state.hasTimedOut:
            known, since = {d[1] for d in held}, set()
            for b in batches:
                for t, i, c, direction, cash in zip(b["txn_epoch"].tolist(), b["transaction_id"].tolist(), b["amount_cents"].tolist(), b["direction"].tolist(), b["is_cash"].tolist(), strict=True):
                    if cash == 1 and direction == "inbound" and i not in known and t >= mark:
                        known.add(i)
                        since.add(t)
                        held.append((t, i, c))
            held.sort()
            rows = [(f"{r.code}|{key[0]}|{ids[0]}|{ids[-1]}", r.code, key[0], a, z, total, ids) for r in rules for a, z, total, ids in windows_at(held, r, since)]
            if rows:
                yield pd.DataFrame(rows, columns=["key", "rule", "entity_id", "window_start", "window_end", "total_cents", "members"])
        # No event to come is before the watermark, so its windows start no earlier than that less the longest window.
        held = [d for d in held if d[0] >= mark - keep]
        if held:
            state.update(tuple(map(list, zip(*held, strict=True))))
            state.setTimeoutTimestamp((max(held[-1][0] + keep, mark) + 1) * 1000)
        elif state.exists:
            state.remove()

    timed = events.withColumn("event_time", F.timestamp_seconds("txn_epoch")).withWatermark("event_time", f"{cfg.lateness} seconds")
    return timed.groupBy("entity_id").applyInPandasWithState(step, ALERT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def start(alert_stream: DataFrame, sink: str, checkpoint: str, **trigger):
    """Writes every batch's alerts under its batch number, so that a batch run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return alert_stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def start_kafka(alert_stream: DataFrame, servers: str, topic: str, checkpoint: str, **options: str):
    """Writes alerts to a compacted Kafka topic under their keys: taken again, an alert replaces itself."""
    sink = to_json(alert_stream).writeStream.format("kafka").outputMode("append").option("kafka.bootstrap.servers", servers)
    return sink.option("topic", topic).option("kafka.acks", "all").option("checkpointLocation", checkpoint).options(**options).start()


def latest_alerts(spark: SparkSession, sink: str) -> DataFrame:
    """The fullest alert per key: of equals the last batch's."""
    rows = spark.read.schema(ALERT + ", batch long").parquet(sink)
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(F.size("members")), F.desc("batch")))
    return rows.withColumn("k", best).where("k = 1").drop("k", "batch")


def flagged_members(found: DataFrame) -> DataFrame:
    """(rule, transaction_id), distinct."""
    return found.select("rule", F.explode("members").alias("transaction_id")).distinct()


def difference(stream: DataFrame, batch: DataFrame) -> DataFrame:
    """(side, rule, transaction_id) of what only the stream or only batch flags: empty if they agree."""
    cols = ["rule", "transaction_id"]
    only = lambda a, b, name: a.select(*cols).distinct().exceptAll(b.select(*cols).distinct()).select(F.lit(name).alias("side"), *cols)
    return only(stream, batch, "stream only").unionByName(only(batch, stream, "batch only"))


def replay(payments: DataFrame, late_share: float = 0.03, late_by: int = 6 * 3600, repeat_share: float = 0.005, repeat_by: int = 3600) -> DataFrame:
    """EVENT columns and arrival (seconds): some events late, some twice, by hashes of their ids."""
    u = lambda salt: F.pmod(F.xxhash64("transaction_id", F.lit(salt)), F.lit(1 << 20)) / float(1 << 20)
    base = payments.select("transaction_id", "entity_id", "txn_epoch", "amount_cents", "direction", "is_cash")
    first = base.withColumn("arrival", F.col("txn_epoch") + F.when(u(1) < late_share, (u(2) * late_by).cast("long")).otherwise(0))
    again = base.where(u(3) < repeat_share).withColumn("arrival", F.col("txn_epoch") + (u(4) * repeat_by).cast("long") + 1)
    return first.unionByName(again)


def progress(query) -> dict:
    """Totals over a query's recent batches: rows in, batches, state rows and rows dropped as late."""
    got = [json.loads(p.json) if hasattr(p, "json") and isinstance(p.json, str) else p for p in query.recentProgress]
    states = [s for p in got for s in p.get("stateOperators", [])]
    return {"batches": len(got), "rows": sum(p.get("numInputRows", 0) for p in got), "state_rows": states[-1].get("numRowsTotal", 0) if states else 0, "late": sum(s.get("numRowsDroppedByWatermark", 0) for s in states)}
