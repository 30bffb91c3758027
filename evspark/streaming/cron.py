"""Cron schedules as a running source: ticks are written while a clock goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evspark.sources.cron import cron_ticks
from evspark.streaming.ledger import written_before

CLOCK = "until timestamp"


def cron_tick_stream(clock: DataFrame, schedules: DataFrame, start: str, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the ticks of all schedules below ``path/ticks``, up to the latest ``ts`` that the stream ``clock`` has brought.

    Each batch writes the ticks behind the latest time of the batches before it (``start`` at first), and its own latest time below
    ``path/clock``. A batch that runs again, also after a restart, starts from the same time and overwrites its own folders, so no
    tick is lost or written twice; a clock that goes back writes nothing. Schedules are expanded by Spark as in ``cron_ticks``.
    """
    spark = clock.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        passed = written_before(spark, f"{path}/clock", CLOCK, batch_id).agg(F.max("until").alias("t"))
        begin = passed.select(F.date_format(F.coalesce("t", F.lit(start).cast("timestamp")), FORMAT)).first()[0]
        end = batch.agg(F.date_format(F.greatest(F.max("ts"), F.lit(begin).cast("timestamp")), FORMAT)).first()[0]
        cron_ticks(schedules, begin, end).write.mode("overwrite").parquet(f"{path}/ticks/batch={batch_id}")
        spark.createDataFrame([(end,)], "until string").select(F.col("until").cast("timestamp")).write.mode("overwrite").parquet(f"{path}/clock/batch={batch_id}")

    return (
        clock.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
