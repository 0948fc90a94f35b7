"""Log lines by day, with retention that drops days instead of rows.

``data/day=D/part=P`` holds the lines of one batch and day. Retention writes a mark (the cutoff,
and for the day that the cutoff cuts the one part that replaces the others) and removes what
the mark makes superfluous: whole days as folders, unread, and the old parts of the cut day.
The mark is the commit: readers go by it, so lines are gone at once and none is seen twice,
whatever a failed run left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe import constants as K

LINE = "platform string, service_name string, ts timestamp, line string"
MARK = "cutoff_us long, day string, kept string, replaced array<string>"
HOUR_US = 3_600_000_000


class LogTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _place(self, name: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _inside(self, name: str) -> list[str]:
        place, system = self._place(name)
        return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []

    def _delete(self, name: str) -> None:
        place, system = self._place(name)
        system.delete(place, True)

    def marks(self) -> list:
        """Committed marks, oldest first: one small row per run of the retention."""
        done = [n for n in self._inside("marks") if "_SUCCESS" in self._inside(f"marks/{n}")]
        paths = [f"{self.path}/marks/{n}" for n in done]
        rows = self.spark.read.schema(MARK).parquet(*paths).collect() if paths else []
        return sorted(rows, key=lambda r: r["cutoff_us"])

    def append(self, lines: DataFrame, batch: str) -> None:
        """One batch; the same batch again replaces its own parts only."""
        rows = lines.select("platform", "service_name", "ts", "line", F.to_date("ts").alias("day"), F.lit(batch).alias("part"))
        (
            rows.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("day", "part").parquet(f"{self.path}/data")
        )

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(f"{LINE}, day date, part string").parquet(f"{self.path}/data")

    def read(self) -> DataFrame:
        """Lines inside the retention; days and parts outside are pruned, not read."""
        if not self._inside("data"):
            return self.spark.createDataFrame([], LINE)
        rows, marks = self._stored(), self.marks()
        kept = [m["kept"] for m in marks]
        rows = rows.filter(~F.col("part").startswith("kept_") | F.col("part").isin(kept))
        for mark in marks[-1:]:
            cutoff = F.timestamp_micros(F.lit(mark["cutoff_us"]))
            rows = rows.filter((F.col("day") >= F.lit(mark["day"]).cast("date")) & (F.col("ts") >= cutoff))
            rows = rows.filter((F.col("day") != F.lit(mark["day"]).cast("date")) | ~F.col("part").isin(mark["replaced"]))
        return rows.select("platform", "service_name", "ts", "line")

    def expire(self, now_us: int, hours: int = K.LOG_RETENTION_HOURS) -> None:
        """Let go of lines older than ``hours``. Repeating it is harmless; a cutoff before
        an earlier one changes nothing."""
        cutoff_us = now_us - hours * HOUR_US
        marks = self.marks()
        if marks and marks[-1]["cutoff_us"] >= cutoff_us:
            return
        day = self.spark.range(1).select(F.to_date(F.timestamp_micros(F.lit(cutoff_us))).cast("string")).first()[0]
        kept = f"kept_{cutoff_us}"
        known = [m["kept"] for m in marks]
        parts = [n.removeprefix("part=") for n in self._inside(f"data/day={day}")]
        replaced = [p for p in parts if p != kept and (not p.startswith("kept_") or p in known)]
        if replaced:
            cut = self._stored().filter((F.col("day") == F.lit(day).cast("date")) & F.col("part").isin(replaced))
            inside = cut.filter(F.col("ts") >= F.timestamp_micros(F.lit(cutoff_us))).drop("day", "part")
            inside.write.mode("overwrite").parquet(f"{self.path}/data/day={day}/part={kept}")
        mark = self.spark.createDataFrame([(cutoff_us, day, kept, replaced)], MARK)
        mark.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/{cutoff_us}")
        for name in self._inside("data"):
            if name.startswith("day=") and name.removeprefix("day=") < day:
                self._delete(f"data/{name}")
        for part in replaced:
            self._delete(f"data/day={day}/part={part}")
