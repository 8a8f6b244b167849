"""The merge of instructions as a stream: each document's events are state between micro-batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomline.operators.merge import EVENT_COLUMNS, Folder, _top_level, flat

_SCHEMA = ", ".join(" ".join(x.split(":", 1)) for x in _top_level(EVENT_COLUMNS))


def _run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = json.loads(state.get[0]) if state.exists else []
    before = [json.dumps(e) for e in held]
    folder = Folder(held)
    rows = pd.concat(list(frames)).sort_values(["batch", "pos"])
    for x in rows.to_dict("records"):
        folder.take(x)
    state.update((json.dumps(folder.events),))
    changed = [{"doc_id": key[0], **e} for i, e in enumerate(folder.events) if i >= len(before) or json.dumps(e) != before[i]]
    if changed:
        yield pd.DataFrame(changed)


def merge_stream(instructions: DataFrame) -> DataFrame:
    """A stream of new and changed events for a stream of instructions; of a (doc_id, seq) the latest row counts.

    Batches of a document must arrive in order; rows within a micro-batch are put in order here.
    """
    return flat(instructions).groupBy("doc_id").applyInPandasWithState(_run, _SCHEMA, "events string", "update", GroupStateTimeout.NoTimeout)


def start(instructions: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Write the changes of each micro-batch under ``path``, with the batch's number, and return the running query."""

    def put(changes: DataFrame, number: int) -> None:
        changes.write.mode("overwrite").parquet(f"{path}/micro={number}")

    writer = merge_stream(instructions).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
