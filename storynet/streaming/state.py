"""The event state of ``storynet.operators.event_state`` as a stream: events are emitted once they are final.

A chat's state is the two events that are still open, their refs and slices as lists, and the number of events so far.
An event leaves the state, and is emitted whole, when two newer ones are open. A chat's batches come in order over
micro-batches; those of one micro-batch are put in order here. A batch that was applied before is left out, so batches
that a source delivers again change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from storynet.operators.event_state import LOOSE_ENDS, SEPARATORS, SLICE, TEXTS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = f"event_no bigint, {', '.join(f'{c} string' for c in TEXTS)}"
SLICES = "event_no bigint, batch_ix bigint, seg_ix bigint, source_refs array<string>, start_anchors string, end_anchors string"
OUT = f"chat_id string, event_no bigint, status string, {', '.join(f'{c} string' for c in TEXTS)}, source_refs array<string>, source_slices array<{SLICE}>"

_LETTERS = re.compile(r"[\W_]+")


def join_texts(left: str, right: str, separator: str) -> str:
    """As the batch form."""
    if not left or not right:
        return left or right
    a, b = _LETTERS.sub("", left), _LETTERS.sub("", right)
    if b and b in a:
        return left
    if a and a in b:
        return right
    return (left.rstrip() if separator == "\n" else left.rstrip(LOOSE_ENDS)) + separator + right


class OpenEvents(StatefulProcessor):
    """Applies the batches of a chat to its open events."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "events bigint, batch_ix bigint")  # events opened, last batch applied
        self.events = handle.getListState("events", EVENT)  # the pending and the forming event, in this order
        self.slices = handle.getListState("slices", SLICES)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        opened, applied = self.seen.get() if self.seen.exists() else (0, -1)
        events = [list(e) for e in self.events.get()] if self.events.exists() else []
        slices = [tuple(s) for s in self.slices.get()] if self.slices.exists() else []
        final = []
        new = pd.concat(list(rows)).sort_values(["batch_ix", "seg_ix"])
        # a frame for each batch would cost more than all that is done with its few rows
        for batch_ix, its in groupby(new[new["batch_ix"] > applied].to_dict("records"), itemgetter("batch_ix")):
            applied, slots, batch = int(batch_ix), {}, list(its)
            opens = any(row["slot"].startswith("new_") for row in batch)
            if opens and batch[0]["disposition"] == "merge_into_pending" and len(events) > 1:
                (older, *texts), (newer, *others) = events[-2:]
                joined = [join_texts(a, b, SEPARATORS[c]) for c, a, b in zip(TEXTS, texts, others, strict=True)]
                events[-2:] = [[older, *joined]]
                # the joined event's slices go after those that the older one has by now
                slices = [s for s in slices if s[0] != newer] + [(older, *s[1:]) for s in slices if s[0] == newer]
            for row in batch:
                if row["slot"] not in slots:
                    if row["slot"].startswith("new_"):
                        opened += 1
                        events.append([opened, *[""] * len(TEXTS)])
                    elif not events:
                        continue
                    slots[row["slot"]] = events[-1]
                event = slots[row["slot"]]
                refs = [] if row["source_refs"] is None else list(row["source_refs"])
                slices.append((event[0], applied, int(row["seg_ix"]), refs, row["start_anchors"], row["end_anchors"]))
                for i, name in enumerate(TEXTS, 1):
                    event[i] = (row[name] or "").strip() or event[i]
            final += events[:-2]
            events = events[-2:]
        self.seen.update((opened, applied))
        gone = {e[0] for e in final}
        kept = [s for s in slices if s[0] not in gone]
        self.events.put([tuple(e) for e in events])
        self.slices.put(kept)
        if final:
            yield self._rows(key[0], final, slices)

    @staticmethod
    def _rows(chat: str, events: list[list], slices: list[tuple]) -> pd.DataFrame:
        out: dict[str, list] = {c: [] for c in ("chat_id", "event_no", "status", *TEXTS, "source_refs", "source_slices")}
        for number, *texts in events:
            own = [s for s in slices if s[0] == number]
            cells = (chat, number, "finalized", *texts, list(dict.fromkeys(r for s in own for r in s[3])), [dict(zip(("batch_ix", "seg_ix", "source_refs", "start_anchors", "end_anchors"), s[1:], strict=True)) for s in own])
            for name, cell in zip(out, cells, strict=True):
                out[name].append(cell)
        return pd.DataFrame(out)

    def close(self) -> None:
        pass


def final_events(plan: DataFrame) -> DataFrame:
    """``plan``, a stream of the columns of ``event_state``: the events that became final, in append mode. Sets the session's state store to RocksDB, which this needs."""
    plan.sparkSession.conf.set(_PROVIDER, _ROCKSDB)
    return plan.groupBy("chat_id").transformWithStateInPandas(OpenEvents(), OUT, "Append", "None")
