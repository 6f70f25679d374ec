"""Training curves as a stream of JSON lines; batch readers give the same numbers.

Windows count rows in time; `followed` keeps each run's last rows as state and
gives every new row its rolling mean and its late change. Both go on where they
were after a restart from the checkpoint, and `appended` writes each row once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.session import ship

CURVE = "run string, step bigint, loss double, at timestamp"


def curve_stream(spark: SparkSession, path: str) -> DataFrame:
    """Rows of appended JSON-lines files as they come."""
    return spark.readStream.schema(CURVE).json(path)


def windowed_loss(rows: DataFrame, width: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Mean loss, last step and rows of each run by tumbling window; rows later than the watermark are left out."""
    timed = rows.withWatermark("at", late).groupBy("run", F.window("at", width).alias("w"))
    return timed.agg(F.avg("loss").alias("loss"), F.max("step").alias("step"), F.count("*").alias("rows")).select("run", F.col("w.start").alias("start"), "loss", "step", "rows")


FOLLOWED = "run string, step bigint, loss double, rolling double, late_change double"
#: The state store that keeps lists for a key.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastRows(StatefulProcessor):
    """The last rows of each run: as many as the rolling mean or the late change needs, however long the run is."""

    def __init__(self, rolling: int, half: int):
        self.rolling, self.half, self.most = rolling, half, max(rolling, 2 * half)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "step bigint, loss double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [(int(s), float(x)) for s, x in self.rows.get()] if self.rows.exists() else []
        new = pd.concat(list(rows)).dropna(subset=["step", "loss"]).sort_values(["step", "loss"]).drop_duplicates("step")
        out = []
        for step, loss in zip(new["step"].tolist(), new["loss"].tolist(), strict=True):
            if held and step <= held[-1][0]:
                continue  # seen before, or behind a later step
            held = [*held, (int(step), float(loss))][-self.most :]
            last = [x for _, x in held]
            mean = sum(last[-self.rolling :]) / self.rolling if len(last) >= self.rolling else None
            k = self.half
            late = sum(last[-k:]) / k - sum(last[-2 * k : -k]) / k if len(last) >= 2 * k else None
            out.append((key[0], int(step), float(loss), mean, late))
        if out:
            self.rows.put(held)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FOLLOWED.split(", ")]).astype({"step": "int64", "loss": "float64", "rolling": "float64", "late_change": "float64"})

    def close(self) -> None:
        pass


def followed(rows: DataFrame, rolling: int = 5, half: int = 4) -> DataFrame:
    """run, step, loss, rolling, late_change of every row of a stream, once.

    rolling is the mean of the run's last rows, late_change the mean of its last `half` rows less that of the `half` before; null
    until there are as many. Steps grow: a step that is not beyond the run's last one is left out, so lines that are written again
    change nothing. Rows without run, step or loss are left out. Sets the session's state store to the one that holds lists.
    """
    spark = rows.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    known = rows.where(F.col("run").isNotNull() & F.col("step").isNotNull() & F.col("loss").isNotNull()).select("run", "step", "loss")
    found = known.groupBy("run").transformWithStateInPandas(LastRows(rolling, half), FOLLOWED, "Append", "none")
    missing = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return found.select("run", "step", "loss", missing("rolling"), missing("late_change"))


def appended(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there to JSON lines below path; a restart with the same checkpoint goes on behind the last committed batch."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
