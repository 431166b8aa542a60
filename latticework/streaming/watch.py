"""Watching files over a stream: what has changed since a path was last seen."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values("at", kind="stable")
    before, out = state.get[0] if state.exists else None, []
    for at, now in zip(rows["at"], rows["hash"]):
        now = None if pd.isna(now) else now
        if now != before:
            out.append((key[0], "added" if before is None else "deleted" if now is None else "modified", at))
            before = now
    if before is None:
        if state.exists:
            state.remove()
    else:
        state.update((before,))
    yield pd.DataFrame(out, columns=["path", "change", "at"])


def file_changes(events: DataFrame) -> DataFrame:
    """(path, change, at) of a stream of sightings (path, hash, at; a null hash: the
    file is gone): added, modified, deleted. The state is one hash for each file that
    is there; a sighting that brings nothing new gives no row."""
    seen = events.select("path", "hash", "at").filter("path is not null")
    return seen.groupBy("path").applyInPandasWithState(_changes, "path string, change string, at timestamp", "hash string", "append", GroupStateTimeout.NoTimeout)
