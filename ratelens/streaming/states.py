"""The states of assignments as a stream over the log of events (an extension: studies keep these in tables)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import columns as C
from ..operators.capture import STATES

#: How far behind an assignment's newest event another one may come and still be put in its place.
SETTLED = "7 days"
#: Milliseconds that a gap between two events counts at most.
CAP_MS = 60_000

_EVENT = "micros bigint, kind string, visible boolean, payload_json string, visible_category string, intensity int, duration_ms bigint, error string"
_COLUMNS = [c.split()[0] for c in _EVENT.split(", ")]
_OUT = STATES.replace("timestamp", "bigint") + ", late bigint"


def fresh_state() -> dict:
    return {"opened": None, "first": None, "last": None, "rating": [None, None, None], "draft": None, "payload": None, "rejected": 0, "active": 0, "before": None}


def folded(state: dict, events: list[tuple[list, dict]]) -> dict:
    """A state after further events (key, event), which come in the order of their keys, all after those it has seen.

    opened, first, last and draft are keys of the first opening, the first and last valid submission and the newest draft;
    before is the event before: its milliseconds and whether the page was visible.
    """
    state = dict(state)
    for key, e in events:
        if e["kind"] == "reset":
            state = fresh_state()
            continue
        millis = e["micros"] // 1000
        if state["before"] and state["before"][1]:
            state["active"] += min(millis - state["before"][0], CAP_MS)
        state["before"] = [millis, bool(e["visible"])]
        if e["kind"] == "opened" and state["opened"] is None:
            state["opened"] = key
        elif e["kind"] == "draft":
            state["draft"], state["payload"] = key, e["payload_json"]
        elif e["kind"] == "submitted" and e["error"] is not None:
            state["rejected"] += 1
        elif e["kind"] == "submitted":
            state["first"] = state["first"] or key
            state["last"], state["rating"] = key, [e["duration_ms"], e["visible_category"], e["intensity"]]
    return state


def shown(state: dict) -> tuple:
    """A state as the columns of STATES behind the assignment, times in microseconds."""
    done = state["last"] is not None
    started = state["opened"][0] if state["opened"] and (state["first"] is None or state["opened"] < state["first"]) else None
    payload = state["payload"] if state["draft"] and (not done or state["draft"] > state["last"]) else None
    status = "complete" if done else "started" if state["opened"] else "pending"
    return status, started, state["last"][0] if done else None, *state["rating"], payload, state["rejected"], state["active"]


class AssignmentStates(StatefulProcessor):
    """Keeps an assignment's unsettled events by id, and what the settled ones before them come to.

    Each batch folds the unsettled events anew in their order, so order and repeats don't matter among them. An event is
    settled when another of its assignment is later by more than the given time; what comes behind settled events is counted
    as late and changes nothing.
    """

    def __init__(self, settled_micros: int):
        self.settled = settled_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getMapState("events", "event_id string", _EVENT)
        self.base = handle.getValueState("base", "json string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        base = json.loads(self.base.get()[0]) if self.base.exists() else {"state": fresh_state(), "settled": None, "late": 0}
        held = {k[0]: dict(zip(_COLUMNS, v)) for k, v in self.events.iterator()}
        for frame in rows:
            for r in frame.astype(object).where(frame.notna(), None).to_dict("records"):
                at = [int(r["micros"]), r["event_id"]]
                if base["settled"] is not None and at <= base["settled"]:
                    base["late"] += 1
                elif r["event_id"] not in held:
                    held[r["event_id"]] = own = {c: r[c] for c in _COLUMNS}
                    for c in ("micros", "intensity", "duration_ms"):
                        own[c] = None if own[c] is None else int(own[c])
                    own["visible"] = bool(own["visible"])
                    self.events.updateValue((r["event_id"],), tuple(own[c] for c in _COLUMNS))
        ordered = sorted(([e["micros"], i], e) for i, e in held.items()) if held else []
        limit = ordered[-1][0][0] - self.settled if ordered else 0
        old = [x for x in ordered if x[0][0] < limit]
        if old:
            base |= {"state": folded(base["state"], old), "settled": old[-1][0]}
            for at, _ in old:
                self.events.removeKey((at[1],))
        self.base.update((json.dumps(base),))
        out = shown(folded(base["state"], ordered[len(old) :]))
        yield pd.DataFrame([(key[0], *out, base["late"])], columns=[c.split()[0] for c in _OUT.split(", ")]).astype({c.split()[0]: "Int64" for c in _OUT.split(", ") if not c.endswith("string")})

    def close(self) -> None:
        pass


def states(events: DataFrame, settled: str = SETTLED) -> DataFrame:
    """A stream of the states (STATES, and how many events came too late) of assignments that had events in a batch.

    events: a stream of rows of capture.EVENTS. Needs the state store that keeps keys on disk, which this sets.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    micros = int(pd.Timedelta(settled).total_seconds() * 1e6)
    error = C.frame_rating_error(F.col("visible_category"), F.col("intensity"))
    duration = C.duration(F.col("duration_ms")).alias("duration_ms")
    rows = events.select("assignment_uuid", "event_id", F.unix_micros("at").alias("micros"), "kind", "visible", "payload_json", "visible_category", "intensity", duration, F.when(F.col("kind") == "submitted", error).alias("error"))
    out = rows.groupBy("assignment_uuid").transformWithStateInPandas(AssignmentStates(micros), _OUT, "update", "none")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("started_at", "completed_at")})


def stored_states(events: DataFrame, folder: str, checkpoint: str, settled: str = SETTLED) -> StreamingQuery:
    """Appends each batch's states under the folder; current_states() reads the result. A batch that runs again writes the
    same folder again."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return states(events, settled).writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_states(stored: DataFrame) -> DataFrame:
    """The newest state of each assignment."""
    by = Window.partitionBy("assignment_uuid").orderBy(F.desc("batch"))
    return stored.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n", "batch")
