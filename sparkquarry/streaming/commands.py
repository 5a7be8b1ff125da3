"""The command queue as a stateful stream: one command of a target runs at a time, the others wait in order."""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "target string, id string, command string, status string, at_ms long"
Transition = tuple[str, str, str, int]  # id, command, status, time


def new_state() -> dict:
    """Events that the watermark hasn't passed yet, the queue, what runs, and ids seen with their times."""
    return {"buffer": [], "pending": [], "running": None, "seen": {}}


def advance(state: dict, until_ms: int, keep_ms: int) -> list[Transition]:
    """Go through the buffered events (ms, kind, id, command) up to a time, in order of time, kind and id.

    "command" puts one into the queue, by its time; "done" ends the one that runs. Whenever none
    runs, the first of the queue starts. An id that has been seen within `keep_ms`, and an end of
    what doesn't run, change nothing.
    """
    ready = sorted((e for e in state["buffer"] if e[0] <= until_ms), key=lambda e: (e[0], e[1], e[2] or ""))
    state["buffer"] = [e for e in state["buffer"] if e[0] > until_ms]
    out: list[Transition] = []
    for ms, kind, id_, command in ready:
        waiting = {p[1] for p in state["pending"]} | ({state["running"][0]} if state["running"] else set())
        state["seen"] = {k: at for k, at in state["seen"].items() if at > ms - keep_ms or k in waiting}
        if kind == "command" and id_ not in state["seen"]:
            state["seen"][id_] = ms
            bisect.insort(state["pending"], [ms, id_, command])
        elif kind == "done" and state["running"] and state["running"][0] == id_:
            out.append((*state["running"], "done", ms))
            state["running"] = None
        if state["running"] is None and state["pending"]:
            _, first, what = state["pending"].pop(0)
            state["running"] = [first, what]
            out.append((first, what, "running", ms))
    return out


def command_states(events: DataFrame, late: str = "10 minutes", keep_hours: int = 24) -> DataFrame:
    """(target, id, command, status, at): when each command of a stream starts to run and when it is done.

    `events` (target, kind, id, command, ts) tells of new commands and of ends (kind "command" or
    "done"). Events wait until the watermark, `late` behind the latest time, has passed them, and
    then count in order of time, so those that arrive late by less than that change nothing, and a
    stream gives what a walk through all events in order gives. Events without target, id, kind
    or time are left out. A target's state holds its queue, and ids for `keep_hours` after they
    were seen; a repeated command is known by these.
    """
    keep_ms = keep_hours * 3_600_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        own = json.loads(state.get[0]) if state.exists else new_state()
        for batch in batches:
            own["buffer"] += batch[["ms", "kind", "id", "command"]].astype(object).where(batch[["ms", "kind", "id", "command"]].notna(), None).values.tolist()
        watermark = state.getCurrentWatermarkMs()
        out = advance(own, watermark, keep_ms)
        state.update((json.dumps(own),))
        if own["buffer"]:
            state.setTimeoutTimestamp(max(watermark + 1, min(e[0] for e in own["buffer"])))
        yield pd.DataFrame([(key[0], *t) for t in out], columns=[c.split()[0] for c in OUT.split(", ")])

    whole = events.where("target IS NOT NULL AND id IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    timed = whole.select("target", "kind", "id", "command", "ts", F.unix_millis("ts").alias("ms"))
    told = timed.groupBy("target").applyInPandasWithState(step, OUT, "data string", "append", "EventTimeTimeout")
    return told.select("target", "id", "command", "status", F.timestamp_millis("at_ms").alias("at"))
