"""The ingest, analyse, publish loop as one streaming query with a keyed store.

Each micro-batch: new items are inserted if absent; the newest unprocessed ones are analysed by an
injected model and gated by the quality predicate; the newest unpublished analyses are handed to an
injected publisher. Tables are parquet versions, so a batch that is run again after a failure starts
from the version before it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiflow.functions import text as T
from lexiflow.operators import dialogs, store

NEWS = "id string, title string, content string, source string, date timestamp, url string, processed boolean, analysed boolean"
ANALYSIS = "news_id string, analysis string, published boolean"
COUNTERS = ("fetched", "processed", "analysed", "published", "errors")


def deduplicated(stream: DataFrame, key: str = "id", event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """Each key once: over all time, or with bounded state within a watermark."""
    if event_time and delay:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


@dataclass
class NewsLoop:
    spark: SparkSession
    path: str
    model: Callable[[], Callable[[list[str]], list[str]]]
    publish: Callable[[list[dict]], list[str]]
    per_cycle: int = 3
    publish_limit: int = 10
    retries: int = 3
    pause: float = 2.0
    #: Gets the counters of a cycle that had errors.
    report: Callable[[dict[str, int]], None] | None = None
    sleep: Callable[[float], None] = time.sleep
    counters: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTERS, 0))

    def _read(self, name: str, schema: str, version: int) -> DataFrame:
        path = f"{self.path}/{name}/version={version}"
        return self.spark.read.schema(schema).parquet(path) if version >= 0 else self.spark.createDataFrame([], schema)

    def last_version(self) -> int:
        """The last batch of which all tables were written."""
        try:
            return self.spark.read.schema("version int").parquet(f"{self.path}/done").agg(F.coalesce(F.max("version"), F.lit(-1))).first()[0]
        except AnalysisException:  # nothing was written yet
            return -1

    def news(self) -> DataFrame:
        return self._read("news", NEWS, self.last_version())

    def analyses(self) -> DataFrame:
        return self._read("analysis", ANALYSIS, self.last_version())

    def cycle(self, batch: DataFrame, number: int) -> None:
        if number <= (before := self.last_version()):
            return
        self.counters = dict.fromkeys(COUNTERS, 0)
        news, analyses = self._read("news", NEWS, before), self._read("analysis", ANALYSIS, before)
        incoming = batch.select("id", "title", "content", "source", "date", "url").withColumn("processed", F.lit(False)).withColumn("analysed", F.lit(False))
        merged = store.insert_ignore(news, incoming, ["id"], [F.desc("date"), "url"])
        pending = store.newest(merged, ~F.col("processed"), "date", "id", self.per_cycle)
        prompts = pending.select("id", dialogs.news_prompt(F.col("title"), F.col("content")).alias("prompt"))
        answers = dialogs.apply_model(prompts, "prompt", "raw", self.model, self.retries).withColumn("analysis", T.answer_clean(F.col("raw")))
        # At most per_cycle rows: the model runs once for each.
        judged = [r.asDict() for r in answers.select("id", "analysis", "error", (F.col("error").isNull() & T.quality_answer(F.col("analysis"))).alias("good")).collect()]
        seen = self.spark.createDataFrame([(j["id"], True, bool(j["good"])) for j in judged], "id string, processed boolean, analysed boolean")
        made = self.spark.createDataFrame([(j["id"], j["analysis"], False) for j in judged if j["good"]], ANALYSIS)
        merged = store.bulk_update(merged, seen, ["id"], ["id"])
        analyses = store.upsert(analyses, made, ["news_id"], ["news_id"])
        due = analyses.where(~F.col("published")).join(merged.select(F.col("id").alias("news_id"), "title", "url", "date"), "news_id")
        messages = due.orderBy(F.desc("date"), "news_id").limit(self.publish_limit).select("news_id", T.compose_message(F.col("title"), F.col("analysis"), F.col("url")).alias("message"))
        sent = self._send([r.asDict() for r in messages.collect()])
        analyses = store.update_where(analyses, F.col("news_id").isin(sent), {"published": F.lit(True)}) if sent else analyses
        for name, table in (("news", merged), ("analysis", analyses)):
            table.write.mode("overwrite").parquet(f"{self.path}/{name}/version={number}")
        self.spark.createDataFrame([(number,)], "version int").coalesce(1).write.mode("append").parquet(f"{self.path}/done")
        for key, n in (("fetched", batch.count()), ("processed", len(judged)), ("analysed", sum(bool(j["good"]) for j in judged)), ("published", len(sent)), ("errors", sum(j["error"] is not None for j in judged))):
            self.counters[key] += n
        if self.report and self.counters["errors"]:
            self.report(dict(self.counters))

    def _send(self, messages: list[dict]) -> list[str]:
        """Ids that were sent. A refused call is repeated after the time the error names (``retry_after``), else after pauses that double."""
        for n in range(self.retries):
            try:
                return self.publish(messages) if messages else []
            except ConnectionError as e:
                if n + 1 < self.retries:
                    self.sleep(getattr(e, "retry_after", None) or self.pause * 2**n)
        self.counters["errors"] += 1
        return []

    def start(self, stream: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Every ``every`` (seconds are kept between 60 and 300), or all that is there and then stop."""
        if every and not 60 <= float(every.split()[0]) <= 300 and "second" in every:
            every = f"{min(300, max(60, int(float(every.split()[0]))))} seconds"
        writer = stream.writeStream.foreachBatch(self.cycle).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
