"""The stateful upserts as streams."""

from collections import Counter

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pricelode.operators.maintenance import counters, replay

def stream_dedup_observations(observations, delay="7 days"):
    """One row per variant, store and time within the watermark."""
    return observations.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["variant_id", "store_id", "ts"])


def _newest(rows):
    last = rows.groupBy("variant_id", "store_id").agg(F.max(F.struct("ts", "price", "in_stock")).alias("o"))
    return last.select("variant_id", "store_id", "o.*")


def _versions(spark, path):
    """Numbers of the whole bases and of the batches below path; a folder is whole once it holds _SUCCESS."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(hadoop.Path(f"{path}/*/_SUCCESS")) or []
    names = [f.getPath().getParent().getName().split("-") for f in found]
    return sorted(int(n) for kind, n in names if kind == "base"), sorted(int(n) for kind, n in names if kind == "batch"), files, hadoop.Path


def read_offers(spark, path):
    """The newest observation per variant and store: the last base and the batches after it, merged."""
    bases, batches, _, _ = _versions(spark, path)
    parts = [f"{path}/base-{bases[-1]}"] if bases else []
    parts += [f"{path}/batch-{n}" for n in batches if not bases or n > bases[-1]]
    return _newest(spark.read.parquet(*parts))


def stream_upsert_offers(observations, spark, path, checkpoint, compact=16):
    """Keeps the newest observation per variant and store in a table below path, to be read by read_offers.

    A micro-batch writes its own keys alone, under its number, so a batch that
    is tried again replaces itself. Every `compact` batches a new base is merged
    from the last one and the batches since; what it covers is removed one
    compaction later, so that readers of the old base may finish.
    """

    def write(batch, number):
        _newest(batch).write.mode("overwrite").parquet(f"{path}/batch-{number}")
        if number % compact == compact - 1:
            session = batch.sparkSession
            bases, batches, files, at = _versions(session, path)
            old = [n for n in bases if n < number]
            read_offers(session, path).write.mode("overwrite").parquet(f"{path}/base-{number}")
            for name in [f"base-{n}" for n in old[:-1]] + [f"batch-{n}" for n in batches if old and n <= old[-1]]:
                files.delete(at(f"{path}/{name}"), True)

    return observations.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _opened(stored, due):
    """Openings of intervals by due observations, held against the stored open prices: price, the one before, and when."""
    rows = replay(stored, due.withColumnsRenamed({"price": "current_price", "ts": "updated_at"})).where(F.col("outcome").isin("imported", "updated"))
    price, at = F.col("current_price"), F.col("updated_at")
    before = F.lag(price).over(Window.partitionBy("variant_id", "store_id").orderBy("_at"))
    rows = rows.withColumn("old_price", F.coalesce(before, "_before")).where(~price.eqNullSafe(F.col("old_price")))
    return rows.select("variant_id", "store_id", price.alias("price"), "old_price", at.alias("started_at"), F.when(F.col("old_price").isNotNull(), at).alias("prev_ended_at"))


def _open_prices(spark, path, number, last):
    """The open interval of each pair after the batches up to last: the newest base before batch `number` and the batches since, merged. None without any."""
    bases, batches, _, _ = _versions(spark, path)
    base = max((n for n in bases if n < number), default=-1)
    parts = [f"{path}/base-{base}"] * (base >= 0) + [f"{path}/batch-{n}" for n in batches if base < n <= last]
    if not parts:
        return None
    newest = spark.read.parquet(*parts).groupBy("variant_id", "store_id").agg(F.max(F.struct("started_at", "price")).alias("o"))
    return newest.select("variant_id", "store_id", "o.*")


def read_price_intervals(spark, path):
    """All openings of intervals that stream_price_intervals has written below path."""
    _, batches, _, _ = _versions(spark, path)
    return spark.read.parquet(*[f"{path}/batch-{n}" for n in batches])


def stream_price_intervals(observations, path, checkpoint, delay="7 days", compact=16):
    """Openings of intervals, with the price and the instant at which the one before was closed, in a table below path, to be read by read_price_intervals.

    An observation may come up to `delay` later than later ones; then the result
    is that of the accepted observations in order of time. Still later ones are
    dropped; amend_price_intervals works them into the written intervals.
    Observations of a (variant, store) wait in the state of an aggregate by time
    (of rows of one time the lowest price counts) until the watermark has passed
    them, so the order in which they arrive doesn't matter. Those due are replayed
    against the pair's open interval, whose price is the last accepted one: a
    price beyond plausible changes is skipped, one that differs opens an interval.

    A micro-batch writes its own openings alone, under its number, and reads no
    batch from its own number on, so one that is tried again replaces itself.
    Every `compact` batches the open intervals are written as a new base, so that
    a batch reads that and the batches since; the base before stays for the batch
    that is tried again.
    """
    rows = observations.where("ts is not null").withWatermark("ts", delay)
    due = rows.groupBy("variant_id", "store_id", "ts").agg(F.min("price").alias("price"))

    def write(batch, number):
        session = batch.sparkSession
        stored = _open_prices(session, path, number, number - 1)
        if stored is None:
            stored = batch.drop("ts").limit(0)
        _opened(stored.withColumnRenamed("price", "current_price"), batch).write.mode("overwrite").parquet(f"{path}/batch-{number}")
        if number % compact == compact - 1:
            bases, _, files, at = _versions(session, path)
            _open_prices(session, path, number, number).write.mode("overwrite").parquet(f"{path}/base-{number}")
            for n in [n for n in bases if n < number][:-1]:
                files.delete(at(f"{path}/base-{n}"), True)

    return due.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)


class ImportWatch(StreamingQueryListener):
    """Adds up what the micro-batches of running imports observe; add it with spark.streams.addListener.

    A batch counts once it is done; `counts` grows while the import runs, without
    a second pass over its rows. Listeners are told a little later than the query.
    """

    def __init__(self, name="import"):
        self.name, self.counts = name, Counter()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None:
            self.counts.update({k: v or 0 for k, v in seen.asDict().items()})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def observed_import(outcomes, name="import"):
    """A stream of import outcomes whose counters an ImportWatch of that name sees, batch by batch."""
    return outcomes.observe(name, *counters())


ALERT_STATE = StructType([StructField("sent_us", LongType()), StructField("price", StringType())])


class CooldownProcessor(StatefulProcessor):
    """Lets an alert through unless one of the last 24 hours was under 1/0.95 of its price; an article's state ends a day after its last alert."""

    def init(self, handle):
        self.handle, self.sent = handle, handle.getListState("sent", ALERT_STATE)

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows)).sort_values(["sent_at", "alert_id"], kind="stable")
        sent = [(int(t), float(p)) for t, p in self.sent.get()]
        out = []
        for alert, ts, price in zip(new["alert_id"], new["sent_at"], new["price"].astype(float), strict=True):
            now = ts.value // 1000
            sent = [(t, p) for t, p in sent if t > now - 86_400_000_000]
            if not sent or price < 0.95 * min(p for _, p in sent):
                out.append((key[0], alert, price))
                sent.append((now, price))
        self.sent.put([(t, str(p)) for t, p in sent])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # Late alerts may still come until the watermark passes, which it does before the timer rings.
        self.handle.registerTimer(max(t for t, _ in sent) // 1000 + 86_400_000 + 1)
        yield pd.DataFrame(out, columns=["canonical_id", "alert_id", "price"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.sent.clear()
        return iter(())

    def close(self):
        pass


def stream_alert_cooldown(alerts, delay="1 day"):
    """canonical_id, alert_id, price of the alerts that the cooldown lets through; alerts more than `delay` late are dropped."""
    timed = alerts.withColumn("sent_at", F.col("sent_at").cast("timestamp")).withWatermark("sent_at", delay)
    return timed.groupBy("canonical_id").transformWithStateInPandas(CooldownProcessor(), outputStructType="canonical_id long, alert_id long, price double", outputMode="append", timeMode="EventTime")
