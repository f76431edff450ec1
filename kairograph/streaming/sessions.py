"""Graph sessions as a stream: the canvas of each session is keyed state that goes when the session has been idle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.session import CANVAS, Canvas, canvas_rows


class Sessions(StatefulProcessor):
    """Nodes, links, pages and open cohorts are maps, so a trigger writes only the entries that it changed."""

    def __init__(self, idle_s: int):
        self.idle = idle_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.top = handle.getValueState("top", "focus long, step int, trail array<long>, seq long, last long")
        self.maps = {
            "nodes": handle.getMapState("nodes", "node long", "step int, expanded boolean"),
            "links": handle.getMapState("links", "a long, b long", "present boolean"),
            "pages": handle.getMapState("pages", "owner long, cohort string", "members array<long>"),
            "opened": handle.getMapState("opened", "owner long", "cohort string"),
        }

    def held(self) -> dict[str, dict]:
        return {name: {tuple(k): tuple(v) for k, v in state.iterator()} for name, state in self.maps.items()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["seq", "at"])  # the actions of one trigger
        before, canvas = self.held(), Canvas()
        if self.top.exists():
            canvas.focus, canvas.step, trail, canvas.seq, canvas.last = self.top.get()
            canvas.trail = list(trail)
            canvas.nodes = {k: list(v) for (k,), v in before["nodes"].items()}
            canvas.links = set(before["links"])
            canvas.pages = {k: list(v) for k, (v,) in before["pages"].items()}
            canvas.opened = {k: v for (k,), (v,) in before["opened"].items()}
        canvas.fold(batch, self.idle)
        after = {"nodes": {(k,): tuple(v) for k, v in canvas.nodes.items()}, "links": {k: (True,) for k in canvas.links},
                 "pages": {k: (v,) for k, v in canvas.pages.items()}, "opened": {(k,): (v,) for k, v in canvas.opened.items()}}
        for name, state in self.maps.items():
            for k in before[name].keys() - after[name].keys():
                state.removeKey(k)
            for k, v in after[name].items():
                if before[name].get(k) != v:
                    state.updateValue(k, v)
        self.top.update((canvas.focus, canvas.step, canvas.trail, canvas.seq, canvas.last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max((canvas.last + self.idle) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield canvas_rows([canvas.row(key[0])])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.top.clear()
        for state in self.maps.values():
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def session_canvases(actions: DataFrame, idle_s: int = 86_400, late: str = "10 minutes") -> DataFrame:
    """The canvas of each session after each trigger that brought actions of it, for a stream of ``actions`` (ACTIONS).

    Actions are folded in the order of seq within a trigger; a session's triggers must not go back in seq. The last
    canvas of a session equals that of ``replay`` over all its actions. Needs the RocksDB state store.
    """
    return actions.where("session IS NOT NULL").withWatermark("at", late).groupBy("session").transformWithStateInPandas(
        Sessions(idle_s), CANVAS, "Update", "EventTime")
