"""Graph sessions: a canvas of nodes and links that the actions of one visitor build up, prune and fold together again."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

#: An action: merge and page bring ``others`` along (neighbours, members), open and page name a ``cohort``, select a ``place`` of the trail.
ACTIONS = "session long, seq long, at timestamp, action string, node long, others array<long>, cohort string, place int"
CANVAS = "session long, seq long, focus long, step int, trail array<long>, nodes array<long>, expanded array<long>, links int, members int, opened int"


@dataclass
class Canvas:
    """What a session shows: node -> [step, expanded], links as ordered pairs, (owner, cohort) -> members, owner -> open cohort."""

    nodes: dict[int, list] = field(default_factory=dict)
    links: set[tuple[int, int]] = field(default_factory=set)
    pages: dict[tuple[int, str], list[int]] = field(default_factory=dict)
    opened: dict[int, str | None] = field(default_factory=dict)
    trail: list[int] = field(default_factory=list)
    focus: int | None = None
    step: int = 0
    seq: int = -1
    last: int | None = None

    def reached(self, anchors: set[int], without: int | None = None) -> set[int]:
        """The nodes that links connect with ``anchors``, on ways that avoid one node."""
        beside: dict[int, list[int]] = {}
        for a, b in self.links:
            if without not in (a, b):
                beside.setdefault(a, []).append(b)
                beside.setdefault(b, []).append(a)
        found = {x for x in anchors if x in self.nodes and x != without}
        work = list(found)
        while work:
            new = [x for x in beside.get(work.pop(), ()) if x in self.nodes and x not in found]
            found.update(new)
            work += new
        return found

    def keep(self, found: set[int]) -> None:
        self.nodes = {k: v for k, v in self.nodes.items() if k in found}
        self.links = {(a, b) for a, b in self.links if a in found and b in found}

    def act(self, action: str, node: int, others: list[int], cohort: str | None, place: int | None) -> None:
        if action in ("merge", "expand"):  # expand goes on along the trail, merge adds beside it
            if action == "expand":
                self.step += 1
                self.trail = [x for x in self.trail if x != node] + [node]
                self.focus = node
            for x in [node, *others]:
                self.nodes.setdefault(x, [self.step, False])
            self.nodes[node][1] = True
            self.links |= {(min(node, x), max(node, x)) for x in others if x != node}
            self.opened.setdefault(node, None)
        elif action == "page":
            held = self.pages.setdefault((node, cohort or ""), [])
            held += [x for x in dict.fromkeys(others) if x not in held]
        elif action == "open" and node in self.opened:
            self.opened[node] = cohort
        elif action == "focus":
            self.focus = node
            self.trail += [] if node in self.trail else [node]
        elif action == "prune":
            self.keep(set(self.nodes) - {node})
            self.trail = [x for x in self.trail if x != node]
            if self.focus == node and self.trail:
                self.focus = self.trail[-1]
        elif action == "collapse" and node in self.nodes:
            anchors = {*self.trail, *(k for k, (_, expanded) in self.nodes.items() if expanded)}
            kept = self.reached(anchors, without=node) | {node}
            self.keep(kept)
            self.nodes[node][1] = False
            self.trail = [x for x in self.trail if x in kept]
            if node in self.opened:
                self.opened[node] = None
        elif action == "select" and node in self.nodes:
            self.trail = self.trail[:max(0, place or 0)] + [node]
            self.keep(self.reached(set(self.trail)))
            self.focus = node
            self.opened = {k: v for k, v in self.opened.items() if k in self.nodes}
            self.pages = {k: v for k, v in self.pages.items() if k[0] in self.nodes}
        elif action == "reset":
            self.__init__(focus=node)

    def fold(self, rows: pd.DataFrame, idle: int) -> None:
        """The actions of ``rows`` in order; a pause of more than ``idle`` microseconds begins the session anew."""
        at = rows["at"].astype("datetime64[us]").astype("int64")
        for seq, now, action, node, others, cohort, place in zip(rows["seq"], at, rows["action"], rows["node"], rows["others"], rows["cohort"], rows["place"], strict=True):
            if self.last is not None and now - self.last > idle:
                self.__init__()
            if not pd.isna(node):
                self.act(action, int(node), [int(x) for x in others] if others is not None else [], cohort, None if pd.isna(place) else int(place))
            self.seq, self.last = int(seq), int(now)

    def row(self, session) -> tuple:
        expanded = sorted(k for k, (_, e) in self.nodes.items() if e)
        return session, self.seq, self.focus, self.step, self.trail, sorted(self.nodes), expanded, len(self.links), sum(map(len, self.pages.values())), sum(v is not None for v in self.opened.values())


COLUMNS = [c.split()[0] for c in CANVAS.split(", ")]


def canvas_rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS).astype({"focus": "Int64"})


def replay(actions: DataFrame, idle_s: int = 86_400) -> DataFrame:
    """The canvas (CANVAS) that each session of a table of ``actions`` (ACTIONS) ends with.

    Actions are dealt by session, sorted by seq and at inside the parts, and read in Arrow batches; a task holds one
    canvas at a time, never a session's rows. A session is folded in order by one task, however long it is.

    Defined cases: a null session or at is left out; a null node does nothing but count as a sign of life; unknown
    actions do the same; a repeated action is applied again; an empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, canvas = None, Canvas()
        for batch in batches:
            done = []
            for session, rows in batch.groupby("session", sort=False):
                if session != current:
                    if current is not None:
                        done.append(canvas.row(current))
                    current, canvas = session, Canvas()
                canvas.fold(rows, idle_s * 1_000_000)
            yield canvas_rows(done)
        if current is not None:
            yield canvas_rows([canvas.row(current)])

    dealt = actions.where("session IS NOT NULL AND at IS NOT NULL").repartition("session").sortWithinPartitions("session", "seq", "at")
    return dealt.mapInPandas(run, CANVAS)
