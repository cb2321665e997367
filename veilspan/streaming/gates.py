"""Stateful streams: ordered fragments, the buffer-then-check gate, and the mapping registry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.enums import TRANSITIONS

#: Characters that a message may buffer.
MOST = 1 << 20


def fragments(stream: DataFrame) -> DataFrame:
    """(stream_id, sequence, accepted) of ``stream(stream_id, sequence, final)``: 0 first, then one more each, none after the final."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (after, ended, good) = state.get if state.exists else (-1, False, True)
        for f in frames:
            out = []
            for sequence, final in zip(f.sequence.tolist(), f.final.tolist(), strict=True):
                good = good and not ended and sequence == after + 1
                out.append(good)
                after, ended = sequence, ended or bool(final)
            yield pd.DataFrame({"stream_id": key[0], "sequence": f.sequence, "accepted": out})
        state.update((after, ended, good))

    return stream.groupBy("stream_id").applyInPandasWithState(step, "stream_id long, sequence long, accepted boolean", "after long, ended boolean, good boolean", "append", GroupStateTimeout.NoTimeout)


def gate(stream: DataFrame, blocks: str, most: int = MOST) -> DataFrame:
    """(message_id, decision, text): fragments are held until the final one; then the whole text is released or blocked.

    ``blocks`` is a pattern; a message over ``most`` characters is rejected, and what was held of it is let go."""
    import re

    bad = re.compile(blocks)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (held, closed) = state.get if state.exists else ("", False)
        for f in frames:
            for text, final in zip(f.text.tolist(), f.final.tolist(), strict=True):
                if closed:
                    continue
                held += text or ""
                if len(held) > most:
                    held, closed = "", True
                    yield pd.DataFrame({"message_id": [key[0]], "decision": ["REJECT"], "text": [None]})
                elif final:
                    block = bool(bad.search(held))
                    yield pd.DataFrame({"message_id": [key[0]], "decision": ["BLOCK" if block else "ALLOW"], "text": [None if block else held]})
                    held, closed = "", True
        state.update((held, closed))

    return stream.groupBy("message_id").applyInPandasWithState(step, "message_id long, decision string, text string", "held string, closed boolean", "append", GroupStateTimeout.NoTimeout)


def registry(stream: DataFrame) -> DataFrame:
    """(mapping_ref, action, result, state, revision) of ``stream(mapping_ref, action, expected_revision)``: a record is created by its
    first command and moves only along the table, at the revision it has."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (now, revision) = state.get if state.exists else ("CREATED", 1)
        for f in frames:
            rows = []
            for action, expected in zip(f.action.tolist(), f.expected_revision.tolist(), strict=True):
                target = TRANSITIONS.get((now, action))
                if expected != revision:
                    result = "STALE_REVISION"
                elif target is None:
                    result = "INVALID_TRANSITION"
                elif target == now:
                    result = "UNCHANGED"
                else:
                    result, now, revision = "CHANGED", target, revision + 1
                rows.append((key[0], action, result, now, revision))
            yield pd.DataFrame(rows, columns=["mapping_ref", "action", "result", "state", "revision"])
        state.update((now, revision))

    return stream.groupBy("mapping_ref").applyInPandasWithState(step, "mapping_ref string, action string, result string, state string, revision long", "now string, revision long", "append", GroupStateTimeout.NoTimeout)
