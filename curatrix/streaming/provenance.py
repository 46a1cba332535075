"""Discoveries as a stream: one state per record, equal to what :func:`curatrix.operators.provenance.merge` makes of the whole."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from curatrix.operators.provenance import EVENT, EVENT_FIELDS, FIELDS, OTHER
from curatrix.operators.store import HISTORY

SNAPSHOT = ", ".join(f"{c} string" for c in (*FIELDS, *OTHER))
SCHEMA = f"{{key}}, {SNAPSHOT}, discovery_history array<{EVENT}>, discovery_count long, first_seen_at string, last_seen_at string"


def _text(v) -> str | None:
    return None if v is None or isinstance(v, float) and v != v or v is pd.NA else str(v)


def own_events(row: dict, now: str | None) -> list[list]:
    """The events of a snapshot as lists in the order of EVENT_FIELDS."""
    history = row.get("discovery_history")
    events = [[_text(e[c]) for c in EVENT_FIELDS] for e in (history if history is not None else []) if e is not None]
    if events or not row.get("source_repository"):
        return events
    own = [row.get(c) for c in FIELDS]
    own[FIELDS.index("harvested_at")] = row.get("harvested_at") or now
    return [own]


class Discoveries:
    """What has been seen of one record: the sums that make its state, from any order of arrival."""

    def __init__(self, told: str | None = None):
        self.seen = json.loads(told) if told else {"n": 0, "latest": [], "first": None, "last": None, "fields": {}, "old": None}

    def told(self) -> str:
        return json.dumps(self.seen)

    def begin(self, row: dict, now: str | None) -> None:
        """The stored snapshot that discoveries add to."""
        count = row.get("discovery_count")
        self.seen["old"] = {c: row.get(c) for c in (*FIELDS, *OTHER, "first_seen_at", "last_seen_at")} | {"events": own_events(row, now)}
        self.seen["old"]["count"] = None if count is None or count != count else int(count)

    def add(self, row: dict, at: int, now: str | None, cap: int) -> None:
        events, s = own_events(row, now), self.seen
        s["n"] += len(events)
        when = EVENT_FIELDS.index("harvested_at")
        first = (events[0][when] if events else None) or row.get("first_seen_at")
        last = (events[-1][when] if events else None) or row.get("last_seen_at")
        if first is not None and (s["first"] is None or at < s["first"][0]):
            s["first"] = [at, first]
        if last is not None and (s["last"] is None or at > s["last"][0]):
            s["last"] = [at, last]
        for c in (*FIELDS, *OTHER):
            if row.get(c) is not None and (c not in s["fields"] or at > s["fields"][c][0]):
                s["fields"][c] = [at, row[c]]
        s["latest"] = heapq.nlargest(cap, s["latest"] + [[at, i, e] for i, e in enumerate(events)][-cap:], key=lambda e: e[:2])

    def state(self, cap: int) -> dict:
        s, old = self.seen, self.seen["old"] or {}
        known = old.get("events") or []
        out = {c: s["fields"][c][1] if c in s["fields"] else old.get(c) for c in (*FIELDS, *OTHER)}
        events = (known + [e[2] for e in sorted(s["latest"], key=lambda e: e[:2])])[-cap:]
        when = EVENT_FIELDS.index("harvested_at")
        count = old.get("count") if old.get("count") is not None else len(known)
        first = old.get("first_seen_at") or (known[0][when] if known else None) or (s["first"] and s["first"][1])
        last = (s["last"] and s["last"][1]) or old.get("last_seen_at") or out["harvested_at"]
        return out | {
            "discovery_history": [dict(zip(EVENT_FIELDS, e, strict=True)) for e in events], "discovery_count": count + s["n"], "first_seen_at": first, "last_seen_at": last,
        }


class ProvenanceProcessor(StatefulProcessor):
    """Adds the discoveries of a key to its state and gives the record's provenance after each micro-batch."""

    def __init__(self, key: str, order: str, now: str | None = None, cap: int = HISTORY):
        self.key, self.order, self.now, self.cap = key, order, now, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("seen", "told string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        seen = Discoveries()
        for row in initialState.to_dict("records"):
            seen.begin({c: v if c in ("discovery_history", "discovery_count") else _text(v) for c, v in row.items()}, self.now)
        self.value.update((seen.told(),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = Discoveries(self.value.get()[0] if self.value.exists() else None)
        for part in rows:
            for row in part.to_dict("records"):
                at = int(row[self.order])
                seen.add({c: v if c == "discovery_history" else _text(v) for c, v in row.items()}, at, self.now, self.cap)
        self.value.update((seen.told(),))
        yield pd.DataFrame([{self.key: key[0], **seen.state(self.cap)}])

    def close(self) -> None:
        pass


def stream(discoveries: DataFrame, stored: DataFrame, key: str, order: str, now: str | None = None, cap: int = HISTORY) -> DataFrame:
    """Provenance of each record with new discoveries, after each micro-batch; ``stored`` gives the states to begin with.

    ``key`` and ``order`` (a whole number, unique for a key) are columns of the stream. Needs the RocksDB state store."""
    kind = discoveries.schema[key].dataType.simpleString()
    return discoveries.groupBy(key).transformWithStateInPandas(
        statefulProcessor=ProvenanceProcessor(key, order, now, cap), outputStructType=SCHEMA.format(key=f"{key} {kind}"), outputMode="Update", timeMode="None", initialState=stored.groupBy(key)
    )
