"""Words as a stream: files arrive in a folder, are tagged as they come, and a job table tells how far each file is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from leafspan.operators.entities import entity_of


def word_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_trigger: int = 64) -> DataFrame:
    """A stream of the rows of Parquet files in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tagged_stream(words: DataFrame, key: str = "word_id", at: str = "loaded_at", late: str = "30 days") -> DataFrame:
    """Words with entity (dates and codes; the stateless rules), each key once while re-deliveries come within ``late``."""
    w = words.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    return w.withColumn("entity", entity_of(F.col("text"), F.lit(False)))


def windowed_counts(words: DataFrame, at: str = "loaded_at", size: str = "1 day", late: str = "30 days") -> DataFrame:
    """Words and tagged words in each window of ``size``; a window closes once the watermark has passed it."""
    w = words.withWatermark(at, late).withColumn("entity", entity_of(F.col("text"), F.lit(False)))
    return w.groupBy(F.window(at, size)).agg(F.count(F.lit(1)).alias("words"), F.count_if(F.col("entity") != "").alias("tagged")).select(F.col("window.start").alias("start"), "words", "tagged")


#: States of a job in the order in which it passes them.
STATES = ("pending", "processing", "completed", "failed")


class Progress(StreamingQueryListener):
    """Calls ``tell`` with (batch, rows so far) after every batch of the queries of a session."""

    def __init__(self, tell):
        super().__init__()
        self.tell, self.rows = tell, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.tell(event.progress.batchId, self.rows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def job_table(spark: SparkSession, out: str) -> DataFrame:
    """file_id, rows, state, error of every job: its farthest state."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("state"))
    last = F.max(F.struct("batch", rank.alias("r"), "state", "rows", "error"))
    return spark.read.parquet(f"{out}/jobs").groupBy("file_id").agg(last.alias("j"), F.sum(F.when(F.col("state").isin("completed", "failed"), F.col("rows"))).alias("n")).select("file_id", F.coalesce("n", "j.rows").alias("rows"), "j.state", "j.error")


def run_jobs(stream: DataFrame, out: str, checkpoint: str, work) -> StreamingQuery:
    """Runs ``work`` on every batch of new rows and writes its result and, per file, rows of the job table: pending as the batch comes in, processing while
    it is worked on, and then completed, or failed with the error; a batch that fails leaves the others alone.

    A batch that is repeated after a loss overwrites its own folders, so results stay whole. A job can be dropped by leaving its file out of what is read.
    """

    def batch(rows: DataFrame, number: int) -> None:
        files = rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("rows"))

        def mark(state: str, error: str | None = None) -> None:
            files.withColumn("state", F.lit(state)).withColumn("error", F.lit(error).cast("string")).write.mode("overwrite").parquet(f"{out}/jobs/batch={number}/step={STATES.index(state)}")

        mark("pending")
        mark("processing")
        try:
            work(rows).write.mode("overwrite").parquet(f"{out}/results/batch={number}")
        except Exception as e:  # noqa: BLE001 - whatever the work raises is the job's error
            mark("failed", f"{type(e).__name__}: {e}".splitlines()[0])
        else:
            mark("completed")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
