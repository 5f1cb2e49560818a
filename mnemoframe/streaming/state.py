"""Stateful stream operators, each the online twin of a batch operator.

State is small per key: a hash, a gate, one open pair, one open window. Rows of one key within a micro-batch are
put in arrival order by the processor, because a shuffle does not keep it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions import refs
from ..operators.intake import GROUP

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rows(batches: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    frames = list(batches)
    return pd.concat(frames, ignore_index=True).sort_values(list(order), kind="stable")


def _in_order(rows: Iterator[Row], by: str) -> list[Row]:
    return sorted(rows, key=lambda row: (row[by] is None, row[by] or 0))


class _Admit(StatefulProcessor):
    def init(self, handle) -> None:
        self.first = handle.getValueState("first", "request_hash string")

    def handleInputRows(self, key, rows, timerValues):
        state = self.first.get()
        known = held = state[0] if state is not None else None
        answer = Row("tenant_ref", "idempotency_key", "arrival", "status")
        for row in _in_order(rows, "arrival"):
            value = row["request_hash"]
            if held is None:
                held = value
                status = "new"
            else:
                status = "replay" if value == held else "conflict"
            yield answer(key[0], key[1], row["arrival"], status)
        if held != known:
            self.first.update((held,))

    def close(self) -> None:
        pass


def admit(requests: DataFrame) -> DataFrame:
    """Online ``first_accept``: ``requests`` carry request_hash and arrival."""
    return requests.select("tenant_ref", "idempotency_key", "arrival", "request_hash").groupBy(
        "tenant_ref", "idempotency_key").transformWithState(
        _Admit(), "tenant_ref string, idempotency_key string, arrival long, status string", "Append", "None")


class _Episodes(StatefulProcessor):
    """State: the links that got in, the open sets until the gate opens, then only the gate.

    Every call to the state is a message to the JVM, so a group is read and written once a batch, and the links of a new group are not looked up.
    """

    def init(self, handle) -> None:
        self.links = handle.getMapState("links", "source_ref string, role string", "arrival long")
        self.group = handle.getValueState("group", "situations string, acts string, gate long")

    def handleInputRows(self, key, rows, timerValues):
        state = self.group.get()
        situations, acts = (set(json.loads(x)) for x in state[:2]) if state is not None else (set(), set())
        gate = state[2] if state is not None else None
        before = (situations.copy(), acts.copy(), gate)
        event = Row(*GROUP, "source_ref", "role", "arrival", "event")
        seen = set()
        for row in _in_order(rows, "arrival"):
            source, role, arrival = row["source_ref"], row["role"], row["arrival"]
            known = (source, role) in seen or (state is not None and self.links.containsKey((source, role)))
            if gate is not None and not known and role != "outcome":
                yield event(*key, source, role, arrival, "sealed")
                continue
            if not known:
                self.links.updateValue((source, role), (arrival,))
            seen.add((source, role))
            if gate is not None:
                # a new outcome of a finished episode sends it to consolidation again
                yield event(*key, source, role, arrival, "requeued" if role == "outcome" and not known else "accepted")
                continue
            (situations if role == "situation" else acts if role == "agent_act" else set()).add(source)
            if situations and acts and len(situations | acts) > 1:
                gate, situations, acts = arrival, set(), set()
                yield event(*key, source, role, arrival, "materialized")
            else:
                yield event(*key, source, role, arrival, "accepted")
        if state is None or (situations, acts, gate) != before:
            self.group.update((json.dumps(sorted(situations)), json.dumps(sorted(acts)), gate))

    def close(self) -> None:
        pass


def episodes(links: DataFrame) -> DataFrame:
    """Online gate and sealing. ``event``: accepted, materialized (the episode appears here), sealed (refused),
    requeued (late outcome of a finished episode). Outcomes that come before wait in the state of their group."""
    schema = ", ".join(f"{c} string" for c in (*GROUP, "source_ref", "role")) + ", arrival long, event string"
    done = links.select(*GROUP, "source_ref", "role", "arrival").groupBy(*GROUP).transformWithState(
        _Episodes(), schema, "Append", "None")
    return done.withColumn("episode_ref", F.when(F.col("event").isin("materialized", "requeued"), refs.episode_ref()).otherwise(""))


class _Pairs(StatefulProcessor):
    def init(self, handle) -> None:
        self.state = handle.getValueState("open", "role string, text string, pairs long")

    def handleInputRows(self, key, rows, timerValues):
        role, text, pairs = self.state.get() or ("", "", 0)
        pair = Row("conv_id", "pair_idx", "user_text", "agent_text", "reason")
        for row in _in_order(rows, "turn"):
            r, t = row["role"], row["text"] or ""
            if r not in ("user", "assistant"):
                continue
            if r == "user":
                text = text + "\n\n" + t if role == "user" else t
                role = "user"
            elif role == "user":
                yield pair(key[0], pairs, text, t, "")
                pairs, role, text = pairs + 1, "", ""
            else:
                yield pair(key[0], pairs, "", t, "assistant_first")
        self.state.update((role, text, pairs))

    def close(self) -> None:
        pass


def pairs(messages: DataFrame) -> DataFrame:
    """User and assistant pairs as soon as they are complete; user messages before an answer merge."""
    return messages.select("conv_id", "turn", "role", "text").groupBy("conv_id").transformWithState(
        _Pairs(), "conv_id long, pair_idx long, user_text string, agent_text string, reason string", "Append", "None")


class LiveWindow:
    """The collecting rule of one owner, free of Spark so that a test can replay it.

    A window closes when its clock is quiet for longer than the period or when it holds ``max_size`` new episodes.
    It starts with the tail of its predecessor; what does not fit stays and its clock restarts at the closing.
    """

    def __init__(self, quiet: int, max_size: int = 32, overlap: int = 4, tail=(), pending=(), clock: int = 0, number: int = 0):
        self.quiet, self.max_size, self.overlap = quiet, max_size, overlap
        self.tail, self.pending, self.clock, self.number = list(tail), list(pending), clock, number

    def close(self, now: int) -> tuple[int, list[str]]:
        window = (self.tail + self.pending)[: self.max_size]
        self.pending = self.pending[len(window) - len(self.tail):]
        self.tail = window[-self.overlap:] if self.overlap else []
        self.clock = now
        self.number += 1
        return self.number - 1, window

    def advance(self, now: int) -> Iterator[tuple[int, list[str]]]:
        """Windows that fall quiet strictly before ``now``."""
        while self.pending and now > self.clock + self.quiet:
            yield self.close(self.clock + self.quiet)

    def add(self, ref: str, at: int) -> Iterator[tuple[int, list[str]]]:
        yield from self.advance(at)
        if ref in self.pending:
            return
        self.pending.append(ref)
        self.clock = at
        if len(self.pending) >= self.max_size:
            yield self.close(at)


class _Windows(StatefulProcessor):
    def __init__(self, quiet: int, max_size: int, overlap: int):
        self.rule = (quiet, max_size, overlap)

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "tail string, pending string, clock long, number long")

    def _load(self) -> LiveWindow:
        if not self.state.exists():
            return LiveWindow(*self.rule)
        tail, pending, clock, number = self.state.get()
        return LiveWindow(*self.rule, json.loads(tail), json.loads(pending), clock, number)

    def _save(self, live: LiveWindow) -> None:
        self.state.update((json.dumps(live.tail), json.dumps(live.pending), live.clock, live.number))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if live.pending:
            self.handle.registerTimer((live.clock + live.quiet) // 1000 + 1)

    @staticmethod
    def _frame(key, closed) -> pd.DataFrame:
        rows = [(key[0], number, position, ref) for number, window in closed for position, ref in enumerate(window)]
        return pd.DataFrame(rows, columns=["owner", "window_no", "position", "episode_ref"])

    def handleInputRows(self, key, rows, timerValues):
        live, closed = self._load(), []
        frame = _rows(rows, "micros", "episode_ref")
        for ref, at in zip(frame["episode_ref"], frame["micros"]):
            closed += live.add(ref, int(at))
        self._save(live)
        yield self._frame(key, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        live = self._load()
        # all that is quiet by now, also what a first closing leaves
        closed = list(live.advance(max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000))
        self._save(live)
        yield self._frame(key, closed)

    def close(self) -> None:
        pass


def windows(arrivals: DataFrame, quiet_seconds: int, max_size: int = 32, overlap: int = 4, delay: str = "1 hour") -> DataFrame:
    """Consolidation windows as they close, by count or by a quiet timer in event time.

    Rows may come late by ``delay``; a window's timer waits as long.
    """
    timed = arrivals.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.select("owner", "episode_ref", "ts", F.unix_micros("ts").alias("micros")).groupBy("owner").transformWithStateInPandas(
        _Windows(quiet_seconds * 1_000_000, max_size, overlap),
        "owner string, window_no long, position long, episode_ref string", "Append", "EventTime")
