"""The life of chunks: processed, invalid, waiting for another try, cancelled.

A closed chunk comes once, with whether its own solve succeeded (``aligned``), the
flags of its frames and the chunks it was matched with (``links``, in either
direction).  A micro-batch decides, session by session:

* a chunk that isn't aligned is ``invalid``;
* the first chunk of a session is ``processed``; if it is invalid, the session is
  stopped and all its other chunks are ``cancelled``;
* any other chunk is ``processed`` if links, also over other chunks of the batch,
  connect it to a processed one, else it is ``waiting``;
* of the waiting ones the newest ``per_batch`` of each session are tried again with
  every batch, up to ``most`` times; then they stay ``lost``.

State is a table in which each epoch owns one folder.  An epoch reads only the
folders of earlier epochs and overwrites its own, so one that was killed and runs
again gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from framequarry.operators.graph import components

STATE = "session string, chunk long, state string, attempt int, links array<long>, valid array<boolean>, at long"


class Lifecycle:
    """``start`` runs a stream of (session, chunk, aligned, links, valid) into the table at ``path``."""

    def __init__(self, spark: SparkSession, path: str, most: int = 3, per_batch: int = 1):
        self.spark, self.path, self.most, self.per_batch = spark, path.rstrip("/"), most, per_batch

    def _folder(self, epoch: int) -> str:
        return f"{self.path}/epoch={epoch:012d}"

    def _epochs(self) -> list[int]:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(where):
            return []
        found = [(f.getPath(), f.getPath().getName()) for f in files.listStatus(where)]
        join = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(int(name[6:]) for path, name in found if name.startswith("epoch=") and files.exists(join(path, "_SUCCESS")))

    def chunks(self, before: int | None = None) -> DataFrame:
        """The newest state of every chunk, of all epochs or those before one."""
        paths = [self._folder(e) for e in self._epochs() if before is None or e < before]
        rows = self.spark.read.schema(STATE).parquet(*paths) if paths else self.spark.createDataFrame([], STATE)
        rest = ["state", "attempt", "links", "valid", "at"]
        return rows.groupBy("session", "chunk").agg(F.max_by(F.struct(*rest), "at").alias("x")).select("session", "chunk", *[F.col("x")[c].alias(c) for c in rest])

    def add(self, batch: DataFrame, epoch: int) -> None:
        """One micro-batch.  Rows that repeat a chunk, here or from an earlier epoch, are ignored (of repeats in a batch the aligned ones count)."""
        known = self.chunks(epoch)
        whole = batch.filter("session is not null and chunk is not null")
        once = whole.groupBy("session", "chunk").agg(F.max_by(F.struct("links", "valid", F.coalesce("aligned", F.lit(False)).alias("aligned")), F.coalesce("aligned", F.lit(False))).alias("x"))
        new = once.select("session", "chunk", "x.links", "x.valid", "x.aligned").join(known, ["session", "chunk"], "left_anti")
        newest = F.row_number().over(W.partitionBy("session").orderBy(F.desc("chunk")))
        again = known.filter((F.col("state") == "waiting") & (F.col("attempt") < self.most)).withColumn("r", newest).filter(F.col("r") <= self.per_batch)
        asked = new.select("session", "chunk", "links", "valid", "aligned", F.lit(0).alias("attempt")).unionByName(again.select("session", "chunk", "links", "valid", F.lit(True).alias("aligned"), "attempt"))
        self._write(self._decide(asked, known, epoch), epoch)

    def _decide(self, asked: DataFrame, known: DataFrame, epoch: int) -> DataFrame:
        asked = asked.checkpoint()
        processed = known.filter("state = 'processed'").select("session", "chunk")
        stopped = known.filter("state = 'invalid' and chunk = 0").select("session").union(asked.filter("chunk = 0 and not aligned").select("session")).distinct()
        able = asked.filter("aligned").join(stopped, "session", "left_anti")
        # Anchors of a session are one node: number -1.
        anchors = processed.union(able.filter("chunk = 0").select("session", "chunk")).distinct()
        named = lambda c: F.struct("session", F.col(c).alias("chunk"))
        links = able.select("session", "chunk", F.explode(F.filter("links", lambda x: x.isNotNull())).alias("other"))
        to_able = links.join(able.select("session", F.col("chunk").alias("other")), ["session", "other"]).select(named("chunk").alias("u"), named("other").alias("v"))
        anchored = links.join(anchors.select("session", F.col("chunk").alias("other")), ["session", "other"]).select("session", "chunk")
        back = known.filter("state = 'processed'").select("session", F.explode("links").alias("chunk")).join(able.select("session", "chunk"), ["session", "chunk"])  # links of later chunks
        anchored = anchored.union(back).union(able.filter("chunk = 0").select("session", "chunk")).distinct()
        to_anchor = anchored.select(named("chunk").alias("u"), F.struct("session", F.lit(-1).cast("long").alias("chunk")).alias("v"))
        roots = components(to_able.union(to_anchor))
        accepted = roots.filter("root.chunk = -1 and node.chunk >= 0").select("node.session", "node.chunk", F.lit(True).alias("accepted"))
        stop = stopped.select("session", F.lit(True).alias("stop"))
        both = asked.join(accepted, ["session", "chunk"], "left").join(stop, "session", "left")
        tried = F.col("attempt") + 1
        state = (
            F.when(~F.col("aligned"), "invalid").when(F.col("stop"), "cancelled").when(F.col("accepted"), "processed")
            .when(tried >= self.most, "lost").otherwise("waiting")
        )
        # a first chunk that fails late cancels what was processed or waits
        late = known.filter("state in ('processed', 'waiting')").join(stopped, "session", "left_semi").join(asked.select("session", "chunk"), ["session", "chunk"], "left_anti")
        at = F.lit(epoch).cast("long").alias("at")
        return both.select("session", "chunk", state.alias("state"), tried.cast("int").alias("attempt"), "links", "valid", at).unionByName(late.select("session", "chunk", F.lit("cancelled").alias("state"), "attempt", "links", "valid", at))

    def _write(self, rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(self._folder(epoch))

    def start(self, stream: DataFrame, checkpoint: str):
        """All that the stream has now; a restart goes on where its checkpoint ends."""
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def flush(self, rounds: int = 30) -> int:
        """After the end of input: waiting chunks are tried until nothing changes, for ``rounds`` rounds at most; returns their number.

        Rounds own folders behind the last epoch's.  Call it once no stream writes any more.
        """
        for done in range(rounds):
            epoch = max(self._epochs(), default=-1) + 1
            known = self.chunks()
            waiting = known.filter((F.col("state") == "waiting") & (F.col("attempt") < self.most))
            if not waiting.limit(1).count():
                return done
            self._write(self._decide(waiting.select("session", "chunk", "links", "valid", F.lit(True).alias("aligned"), "attempt"), known, epoch), epoch)
        return rounds

    def frames(self, n: int) -> DataFrame:
        """session, idx, valid: a frame counts if its chunk is processed and its own flag is set.

        A chunk has ``n`` frames and the one that also opens the next chunk, which is
        the next chunk's to say.
        """
        each = self.chunks().select("session", "chunk", "state", F.posexplode(F.slice("valid", 1, n)).alias("i", "flag"))
        return each.select("session", (F.col("chunk") * n + F.col("i")).alias("idx"), (F.coalesce("flag", F.lit(False)) & (F.col("state") == "processed")).alias("valid"))
