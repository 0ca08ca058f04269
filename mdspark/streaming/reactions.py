"""Reactions counted while simulations still write their bond files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.frames import frame_molecules, frame_reactions
from .readers import stream_chunks

#: What a stream of these reactions needs as its state store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Seconds that timestep 0 stands behind the watermark's own beginning, so that it is not late.
FIRST = 1
EVENTS = "sim int, t1 bigint, t2 bigint, cluster bigint, reaction string, n bigint"


class Reactions(StatefulProcessor):
    """Of one simulation: the last frame's molecules, frames that wait for the watermark, and how often each reaction was seen.

    A frame is compared with the one before it once the watermark has passed it, so frames may come in any order as
    long as they are not later than the watermark allows; those are dropped by Spark. A frame that comes twice
    counts as it came last. The state is one frame, those that wait, and a number for each reaction.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "timestep bigint, molecules string")
        self.waiting = handle.getMapState("waiting", "timestep bigint", "molecules string")
        self.counts = handle.getMapState("counts", "reaction string", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for t in rows:
            for step, molecules in zip(t["timestep"], t["molecules"]):
                self.waiting.updateValue((int(step),), (json.dumps([[m["label"], [int(x) for x in m["atom_ids"]]] for m in molecules]),))
                self.handle.registerTimer((int(step) + FIRST) * 1000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() // 1000 - FIRST
        due = sorted((k[0], v[0]) for k, v in self.waiting.iterator() if k[0] <= until)
        out = []
        for step, text in due:
            self.waiting.removeKey((step,))
            if self.last.exists():
                t1, before = self.last.get()
                if step <= t1:
                    continue
                for cluster, reaction, _, _ in frame_reactions(json.loads(before), json.loads(text)):
                    n = (self.counts.getValue((reaction,))[0] if self.counts.containsKey((reaction,)) else 0) + 1
                    self.counts.updateValue((reaction,), (n,))
                    out.append((key[0], t1, step, cluster, reaction, n))
            self.last.update((step, text))
        yield pd.DataFrame(out, columns=["sim", "t1", "t2", "cluster", "reaction", "n"]) if out else pd.DataFrame()

    def close(self) -> None:
        pass


def live_reactions(frames: DataFrame, late: int = 0) -> DataFrame:
    """A stream of (sim, t1, t2, cluster, reaction, n) from a stream of (sim, timestep, molecules).

    n: how often the simulation has shown the reaction up to this event. late: by how many timesteps a frame may lag
    behind the newest; a frame is settled once a frame of any simulation is more than that ahead of it.
    """
    timed = frames.withColumn("at", F.timestamp_seconds(F.col("timestep") + FIRST)).withWatermark("at", f"{late} seconds")
    return timed.groupBy("sim").transformWithStateInPandas(Reactions(), EVENTS, "Append", "EventTime")


def stream_reactions(spark: SparkSession, folder: str, elements: DataFrame, late: int = 0, sim: str = r"_R(\d+)") -> DataFrame:
    """live_reactions of the bond files that appear in folder; sim finds a simulation's number in a file's path."""
    spark.conf.set(*STATE_STORE)
    return live_reactions(frame_molecules(stream_chunks(spark, folder, "# Timestep", sim).drop("arrived"), elements), late)
