"""State carried along a recording, as Structured Streaming and as a batch fold that gives the same rows on ordered input.

A carrier is a step: (state, row) -> rows out, with a state that JSON can hold. ``stream_fold`` keeps it per key in the
state store, ``batch_fold`` runs it over each key's sorted rows. Late rows are dropped by the watermark of the source.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from screenlake.functions.storage import new_path

Step = Callable[[dict, dict], list[dict]]


def _names(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(",")]


def _run(step: Step, state: dict, pdf: pd.DataFrame, order: list[str]) -> list[dict]:
    out: list[dict] = []
    for row in pdf.sort_values(order).to_dict("records"):
        out += step(state, row)
    return out


def stream_fold(stream: DataFrame, key: str, order: list[str], schema: str, step: Step) -> DataFrame:
    """The step over an unbounded table, one state a key; rows of a micro-batch are put in order first."""

    def fold(_: tuple, pdfs: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else {}
        out = _run(step, state, pd.concat(list(pdfs)), order)
        held.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=_names(schema))

    return stream.groupBy(key).applyInPandasWithState(fold, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def batch_fold(df: DataFrame, key: str, order: list[str], schema: str, step: Step) -> DataFrame:
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_run(step, {}, pdf, order), columns=_names(schema))

    return df.groupBy(key).applyInPandas(fold, schema)


def run_to_table(stream: DataFrame, name: str, spark: SparkSession) -> DataFrame:
    """Everything that is there now, through a file sink in the shared folder; then the sink as a table."""
    out = new_path(spark, f"stream-{name}")
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def unchanged_step(pixel: int) -> Step:
    """Whether a frame equals the one before within ``pixel``."""

    def step(state: dict, r: dict) -> list[dict]:
        thumb, last = [int(v) for v in r["thumb"]], state.get("thumb")
        state["thumb"] = thumb
        return [{"burst": r["burst"], "frame": r["frame"], "same": last is not None and max(abs(a - b) for a, b in zip(thumb, last, strict=True)) <= pixel}]

    return step


def carried_step(state: dict, r: dict) -> list[dict]:
    """The clock until it is read again."""
    if r["clock"] is not None and r["clock"] == r["clock"]:
        state["clock"] = r["clock"]
    return [{"video": r["video"], "seq": r["seq"], "held": state.get("clock")}]


def said_once(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first of equal readings within the watermark, so that state stays bounded."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def cues_on_screens(screens: DataFrame, cues: DataFrame, hold: int = 30, delay: str = "1 minute") -> DataFrame:
    """(video, start, t, text): cues in the ``hold`` seconds from a screen's start; both sides forget behind their watermarks."""
    s = screens.select(F.col("video"), F.col("ts").alias("start")).withWatermark("start", delay).alias("s")
    c = cues.select(F.col("video").alias("v"), F.col("ts").alias("t"), "text").withWatermark("t", delay).alias("c")
    near = F.expr(f"video = v AND t >= start AND t < start + INTERVAL {hold} SECONDS")
    return s.join(c, near, "inner").select("video", "start", "t", "text")
