"""Readings kept in an order that later work finds ready: by series and span, sorted by instant; and kept with their deltas while late ones arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.durations import ns
from gaugeworks.functions import nav
from gaugeworks.operators.spans import SPAN, SPAN_ROWS, STORED, assigned, handed, index
from gaugeworks.sources.readings import SCHEMA
from gaugeworks.storage import stored


def store(df: DataFrame, name: str, rows: int = SPAN_ROWS, buckets: int | None = None) -> DataFrame:
    """Writes ``df`` as table ``name``, in buckets by series and span, one file each, sorted by instant; returns it as ``load`` does.

    The span stands beside each reading, so windows over it exchange no readings; what they hand from span to span is one row for each.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = assigned(df, index(df, rows)).repartition(n, "series_id", SPAN)
    cut.write.format("parquet").bucketBy(n, "series_id", SPAN).sortBy("series_id", SPAN, "chron_ns", "seq").mode("overwrite").saveAsTable(name)
    return load(df.sparkSession, name)


def load(spark: SparkSession, name: str) -> DataFrame:
    """The table with its order made known: what reads it in that order doesn't sort it again."""
    # Every bucket is one file, so the files' order is the buckets'.
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    return handed(spark.table(name), STORED)


#: Low bits of seq that number the readings of one batch; the batch's number stands above them.
BATCH_BITS = 36


class LateTable:
    """Readings with their deltas, in files by a hash of series and by span of time, into which late batches are merged.

    A batch rewrites only the files of spans that it touches and of the next span with a reading, whose first delta it changes. An index
    of one row for each series and span tells what lies before and after. Batches are numbered in the order in which they
    count; one that comes again, after a crash half-way or from a stream that starts anew, replaces itself.
    """

    def __init__(self, spark: SparkSession, path: str, span: int | str = "1d", parts: int = 16):
        self.spark, self.path, self.size, self.parts = spark, path.rstrip("/"), ns(span), parts

    SCHEMA = "series_id string, seq long, chron_ns long, meas double, dchron_ns long, dmeas double, part int, span long"
    INDEX = "series_id string, first_chron long, last_chron long, last_seq long, last_meas double, n long, part int, span long"

    def _read(self, what: str, schema: str) -> DataFrame:
        found = self.spark.read.schema(schema)
        try:
            return found.parquet(f"{self.path}/{what}")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def readings(self) -> DataFrame:
        """series_id, seq, chron_ns, meas, dchron_ns, dmeas."""
        return self._read("readings", self.SCHEMA).drop("part", "span")

    def index(self) -> DataFrame:
        return self._read("index", self.INDEX)

    def merge(self, batch: DataFrame, number: int) -> int:
        """Takes in ``batch`` (readings; seq orders equal instants within it) and returns how many rows were rewritten, its own among them."""
        where = [F.pmod(F.xxhash64("series_id"), F.lit(self.parts)).cast("int").alias("part"), F.floor(F.col("chron_ns") / self.size).alias("span")]
        order = Window.partitionBy("series_id", "chron_ns").orderBy("seq")
        own = batch.select(*SCHEMA.names).withColumn("seq", F.lit(number << BATCH_BITS) + F.row_number().over(order))
        own = stored(own.select(*SCHEMA.names, *where), "late-batch")
        touched = own.select("series_id", "part", "span").distinct()
        known = self.index()
        # The next span of each touched one's series that has readings: the nearest after it, touched itself or not.
        series = touched.select(F.col("series_id").alias("__id")).distinct()
        mine = known.join(series, F.col("series_id").eqNullSafe(F.col("__id")), "left_semi").select("series_id", "part", "span")
        places = mine.withColumn("hit", F.lit(False)).unionByName(touched.withColumn("hit", F.lit(True))).groupBy("series_id", "part", "span").agg(F.max("hit").alias("hit"))
        after = F.lag("hit").over(Window.partitionBy("series_id").orderBy("span"))
        rewritten = stored(places.withColumn("hit", F.col("hit") | F.coalesce(after, F.lit(False))).filter("hit").select("series_id", "part", "span"), "late-spans")
        files = rewritten.select(F.col("part").alias("p"), F.col("span").alias("s")).distinct()  # at most two for each series and span of the batch
        fresh = (F.shiftright("seq", BATCH_BITS) != number)
        old = self._read("readings", self.SCHEMA)
        old = old.join(F.broadcast(files), (F.col("part") == F.col("p")) & (F.col("span") == F.col("s")), "left_semi").filter(fresh)
        every = old.select(*SCHEMA.names, "part", "span").unionByName(own)
        # What each span hands on: of those that are rewritten as they are now, of the others from the index.
        key = F.struct("chron_ns", "seq")
        now = every.groupBy("series_id", "part", "span").agg(F.min("chron_ns").alias("first_chron"), F.max_by(F.struct("chron_ns", "seq", "meas"), key).alias("e"), F.count("*").alias("n"))
        now = now.select("series_id", "first_chron", F.col("e.chron_ns").alias("last_chron"), F.col("e.seq").alias("last_seq"), F.col("e.meas").alias("last_meas"), "n", "part", "span")
        kept = known.join(F.broadcast(files), (F.col("part") == F.col("p")) & (F.col("span") == F.col("s")), "left_anti")
        now = stored(now, "late-index")
        near = kept.join(now.select(F.col("series_id").alias("__id")).distinct(), F.col("series_id").eqNullSafe(F.col("__id")), "left_semi").unionByName(now)
        before = F.lag(F.struct(F.col("last_chron").alias("chron_ns"), F.col("last_meas").alias("meas"))).over(Window.partitionBy("series_id").orderBy("span"))
        carry = near.select(F.col("series_id").alias("__id"), F.col("span").alias("__at"), before.alias("carry"))
        met = every.join(carry, F.col("series_id").eqNullSafe(F.col("__id")) & (F.col("span") == F.col("__at")), "left")
        last = F.coalesce(F.lag(F.struct("chron_ns", "meas")).over(Window.partitionBy("series_id", "span").orderBy("chron_ns", "seq")), F.col("carry"))
        met = met.withColumn("__last", last)
        told = met.select(*SCHEMA.names, (F.col("chron_ns") - F.col("__last.chron_ns")).alias("dchron_ns"), F.when(F.col("__last").isNotNull(), nav.sub("meas", F.col("__last.meas"))).alias("dmeas"), "part", "span")
        made = stored(told, "late-rewritten")  # it reads what is now written over
        self._replace(made.repartition("part", "span").sortWithinPartitions("series_id", "chron_ns", "seq"), "readings")
        self._replace(now.repartition("part", "span"), "index")
        return made.count()

    def _replace(self, rows: DataFrame, what: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "span").parquet(f"{self.path}/{what}")

    def follow(self, stream: DataFrame, checkpoint: str):
        """Merges what a stream brings, batch by batch; returns the started query."""
        return stream.writeStream.foreachBatch(lambda batch, number: self.merge(batch, number + 1) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
