"""Streams of packets: dictionaries and slice stacks as keyed state, and counts by time.

Order inside a sequence or track is the packet's place; a micro-batch is put in that order before it is applied. State is
one row per key: a serialized dictionary, or the open slices.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.interning import KIND_NAMES
from ..session import ship


def resolved_stream(packets: DataFrame) -> DataFrame:
    """packets: seq, packet_idx, cleared, dropped, needs, entries (array of table, iid, value), lookups (array of table, iid, inline).

    Out: seq, packet_idx, table, iid, text; as the batch operator has it.
    """
    ship(packets.sparkSession)
    kinds = dict(KIND_NAMES)

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        valid, names = (lambda v, n: (v, json.loads(n)))(*state.get) if state.exists else (False, {})
        out = []
        for r in pd.concat(list(frames)).sort_values("packet_idx").itertuples(index=False):
            if r.dropped or r.cleared:
                valid, names = bool(r.cleared), {}
            for e in r.entries if r.entries is not None else ():
                names[f"{e['table']}#{e['iid']}"] = e["value"]
            for x in r.lookups if r.lookups is not None else ():
                iid = x["iid"]
                if iid is None or pd.isna(iid):
                    text, iid = x["inline"], None
                elif r.needs and not valid:
                    text = None
                else:
                    text = names.get(f"{x['table']}#{int(iid)}", f"<missing {kinds[x['table']]} iid={int(iid)}>")
                out.append((key[0], r.packet_idx, x["table"], iid, text))
        state.update((valid, json.dumps(names)))
        yield pd.DataFrame(out, columns=["seq", "packet_idx", "table", "iid", "text"]).astype({"iid": "Int64"})

    return packets.groupBy("seq").applyInPandasWithState(step, "seq bigint, packet_idx bigint, table string, iid bigint, text string", "valid boolean, names string", "append", "NoTimeout")


def slices_stream(events: DataFrame) -> DataFrame:
    """events: track, packet_idx, ts, type, name. Out, when a slice ends: track, begin_idx, end_idx, ts, dur, depth, path."""
    ship(events.sparkSession)

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        stack = json.loads(state.get[0]) if state.exists else []
        out = []
        for r in pd.concat(list(frames)).sort_values(["ts", "type", "packet_idx"]).itertuples(index=False):
            if r.type == 1:
                stack.append([int(r.packet_idx), int(r.ts), r.name])
            elif r.type == 2 and stack:
                idx, ts, _ = stack[-1]
                out.append((key[0], idx, r.packet_idx, ts, r.ts - ts, len(stack), "/".join(x[2] or "" for x in stack)))
                stack.pop()
        state.update((json.dumps(stack),))
        yield pd.DataFrame(out, columns=["track", "begin_idx", "end_idx", "ts", "dur", "depth", "path"])

    return events.groupBy("track").applyInPandasWithState(step, "track bigint, begin_idx bigint, end_idx bigint, ts bigint, dur bigint, depth int, path string", "stack string", "append", "NoTimeout")


def counts_stream(events: DataFrame, *, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by time window, track and name; at: the event's time. Late rows beyond the watermark are left out, as Spark has it."""
    return events.withWatermark("at", late).groupBy(F.window("at", width), "track", "name").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "track", "name", "n")
