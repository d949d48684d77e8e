"""Continuous ingest into a keyword index: a sink whose batches count once, and an index that grows by batches.

Each batch of documents writes its postings, its documents and what it changes in the counts (terms' documents,
number and length of documents) into folders of its own; a commit file makes it count. A batch that runs
again after a crash overwrites what it had left and commits; one that is committed is a no-op. A document that
comes again replaces its older text.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators.lexical import Postings, build_postings
from kbspark.sources.store import remove

#: Committed batches from which fold() makes one.
FOLD_FROM = 8
TABLES = ("tf", "docs", "df", "stats")


class KeywordIndex:
    """A function for foreachBatch, and the index that it writes. Batches hold (repo_id, id, text); of rows with one id in a batch the text that sorts last counts.

    One stream writes an index; its batch numbers go up.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    # -- commits: a file for each batch or folded run of batches, which names its folder and the last batch in it

    def commits(self) -> list[dict]:
        """Folders that count, oldest first. A folded run replaces the batches that it covers."""
        if not self._fs.exists(self._at("commits")):
            return []
        found = []
        for s in self._fs.listStatus(self._at("commits")):
            if s.getPath().getName().endswith(".json"):
                stream = self._fs.open(s.getPath())
                found.append(json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
                stream.close()
        folded = max((c["last"] for c in found if c["folded"]), default=-1)
        return sorted((c for c in found if (c["folded"] and c["last"] == folded) or (not c["folded"] and c["last"] > folded)), key=lambda c: c["last"])

    def _commit(self, folder: str, last: int, folded: bool) -> None:
        draft, final = self._at(f"commits/{folder}.draft"), self._at(f"commits/{folder}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"folder": folder, "last": last, "folded": folded}).encode()))
        out.close()
        if not self._fs.rename(draft, final):  # it is there already
            self._fs.delete(draft, False)

    # -- reading

    def _read(self, name: str, commits: list[dict]) -> DataFrame | None:
        out = None
        for c in commits:
            rows = self.spark.read.parquet(f"{self.path}/{name}/{c['folder']}").withColumn("batch", F.lit(c["last"]).cast("long"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def _live(self, commits: list[dict]) -> DataFrame:
        """(repo_id, id, batch, length): the batch that holds a document's last text."""
        return self._read("docs", commits).groupBy("repo_id", "id").agg(F.max("batch").alias("batch"), F.max_by("length", "batch").alias("length"))

    def postings(self) -> Postings:
        """The index of all committed batches; its counts are sums of the batches' changes, no count is made anew."""
        commits = self.commits()
        if not commits:
            raise ValueError("nothing was committed yet")
        live = self._live(commits)
        tf = self._read("tf", commits).join(live.select("repo_id", "id", "batch"), ["repo_id", "id", "batch"], "left_semi").drop("batch")
        terms = self._read("df", commits).groupBy("repo_id", "term").agg(F.sum("df").alias("df")).filter("df > 0")
        sums = self._read("stats", commits).groupBy("repo_id").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).filter("n > 0")
        return Postings(tf, terms, sums.select("repo_id", "n", (F.col("length") / F.col("n")).alias("avgdl")))

    # -- writing

    def __call__(self, batch: DataFrame, number: int) -> None:
        commits = self.commits()
        if commits and commits[-1]["last"] >= number:
            return
        folder = f"b{number:09d}"
        self._write(batch, folder, commits)
        self._commit(folder, number, False)

    def _write(self, batch: DataFrame, folder: str, commits: list[dict]) -> None:
        path = lambda name: f"{self.path}/{name}/{folder}"
        docs = batch.groupBy("repo_id", "id").agg(F.max("text").alias("text"))
        docs.write.mode("overwrite").parquet(path("texts"))  # the batch is read once
        docs = self.spark.read.parquet(path("texts"))
        made = build_postings(docs, "id", "text")
        made.tf.write.mode("overwrite").parquet(path("tf"))
        tf = self.spark.read.parquet(path("tf"))
        lengths = tf.groupBy("repo_id", "id").agg(F.max("length").alias("length"))
        known = docs.select("repo_id", "id").join(lengths, ["repo_id", "id"], "left").withColumn("length", F.coalesce("length", F.lit(0)))
        known.write.mode("overwrite").parquet(path("docs"))
        new = self.spark.read.parquet(path("docs"))
        df = tf.select("repo_id", "term", F.lit(1).alias("df"))
        stats = new.select("repo_id", F.lit(1).alias("n"), "length")
        if commits:
            # what the replaced texts had added is taken back
            old = self._live(commits).join(new.select("repo_id", "id"), ["repo_id", "id"], "left_semi")
            gone = self._read("tf", commits).join(old.select("repo_id", "id", "batch"), ["repo_id", "id", "batch"], "left_semi")
            df = df.unionByName(gone.select("repo_id", "term", F.lit(-1).alias("df")))
            stats = stats.unionByName(old.select("repo_id", F.lit(-1).alias("n"), (-F.col("length")).alias("length")))
        df.groupBy("repo_id", "term").agg(F.sum("df").alias("df")).filter("df != 0").write.mode("overwrite").parquet(path("df"))
        stats.groupBy("repo_id").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).write.mode("overwrite").parquet(path("stats"))
        remove(self.spark, path("texts"))

    def fold(self, least: int = FOLD_FROM) -> bool:
        """Makes one folder of all committed batches, if there are at least so many. Their folders go at the next folding, so that readers of now can end."""
        commits = self.commits()
        if len(commits) < least:
            return False
        last, folder = commits[-1]["last"], f"f{commits[-1]['last']:09d}"
        p, live = self.postings(), self._live(commits)
        p.tf.write.mode("overwrite").parquet(f"{self.path}/tf/{folder}")
        live.drop("batch").write.mode("overwrite").parquet(f"{self.path}/docs/{folder}")
        p.terms.write.mode("overwrite").parquet(f"{self.path}/df/{folder}")
        self._read("stats", commits).groupBy("repo_id").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).write.mode("overwrite").parquet(f"{self.path}/stats/{folder}")
        before = {s.getPath().getName()[:-5] for s in self._fs.listStatus(self._at("commits")) if s.getPath().getName().endswith(".json")}
        self._commit(folder, last, True)
        current = {c["folder"] for c in commits}
        for name in before - current:  # replaced by an earlier folding
            self._fs.delete(self._at(f"commits/{name}.json"), False)
            for t in TABLES:
                remove(self.spark, f"{self.path}/{t}/{name}")
        return True
