"""Server-sent events out of a stream of chunks: state of each connection holds the line that isn't whole yet."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "connection string, number long, kind string, body string"
PREFIX = b"data: "


def whole_lines(rest: bytes, chunk: bytes) -> tuple[list[bytes], bytes]:
    """The lines that end in the chunk, and what is left over."""
    *lines, rest = (rest + chunk).split(b"\n")
    return lines, rest


def events(chunks: DataFrame) -> DataFrame:
    """(connection, number, kind, body) of chunks (connection, seq, data), a stream: each whole line that begins with `data: `.

    However the bytes are cut into chunks, the events are the same, in the order of seq; lines end with \\n. Chunks of one
    connection must come in order of seq from batch to batch; inside a batch they are ordered here. A line that is no JSON
    object with a type is dropped, and so is one that never ends.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        rest, number = state.get if state.exists else (b"", 0)
        parts = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out = []
        for data in parts["data"]:
            lines, rest = whole_lines(bytes(rest), bytes(data or b""))
            for line in lines:
                if line.startswith(PREFIX):
                    try:
                        body = json.loads(line[len(PREFIX) :])
                    except ValueError:
                        continue
                    if isinstance(body, dict) and isinstance(body.get("type"), str):
                        out.append((key[0], number, body["type"], line[len(PREFIX) :].decode("utf-8", "replace")))
                        number += 1
        state.update((bytes(rest), number))
        yield pd.DataFrame(out, columns=["connection", "number", "kind", "body"])

    rows = chunks.select(F.col("connection").cast("string"), "seq", F.col("data").cast("binary"))
    return rows.groupBy("connection").applyInPandasWithState(run, EVENT, "rest binary, number long", "append", GroupStateTimeout.NoTimeout)


def newest(log: DataFrame, most: int = 50) -> DataFrame:
    """(key, entries) after each batch of a stream of (key, seq, entry): the key's newest `most` entries, oldest first.

    State holds that many entries a key, whatever the stream's length; equal to the batch query over the whole log if seq
    doesn't fall from batch to batch.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, entries = (list(x) for x in state.get) if state.exists else ([], [])
        for f in frames:
            seqs += [int(x) for x in f["seq"]]
            entries += list(f["entry"])
            order = sorted(range(len(seqs)), key=lambda i: seqs[i])[-most:]
            seqs, entries = [seqs[i] for i in order], [entries[i] for i in order]
        state.update((seqs, entries))
        yield pd.DataFrame({"key": [key[0]], "entries": [entries]})

    rows = log.select(F.col("key").cast("string"), "seq", F.col("entry").cast("string"))
    return rows.groupBy("key").applyInPandasWithState(run, "key string, entries array<string>", "seqs array<long>, entries array<string>", "update", GroupStateTimeout.NoTimeout)
