"""A stored inverted index: postings by term, appended per batch of documents.

Below `path`: postings (term, id, seq, dl, tf) and terms (term, df), both in folders by batch
and by bucket of the term, sorted by term; docs (id, seq, dl) by batch. A search reads the
buckets of its terms only, and of these files the row groups that can hold them. A batch
counts once its docs are written, which happens last, so that what a lost run has left is not
seen; a batch that is written again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources import scratch
from ..sources.readers import table_exists
from .bm25 import Bm25Index
from .membership import among

BUCKETS = 64
#: Up to so many terms are named in the filter of a scan; more are joined.
NAMED_TERMS = 1000


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def term_counts(words: DataFrame) -> DataFrame:
    """(term, id, seq, dl, tf) of words (id, seq, w: a document's tokens): runs of its sorted
    tokens. A document is counted within its row, whatever a task holds of them."""
    rows = words.select("id", "seq", F.sort_array("w").alias("w"), F.size("w").alias("dl"))
    begins = F.filter(F.sequence(F.lit(0), F.col("dl")), lambda i: (i == 0) | (i == F.col("dl")) | (F.get("w", i) != F.get("w", i - 1)))
    rows = rows.withColumn("b", begins)  # of the runs, and where the last one ends
    runs = F.transform(F.slice("b", F.lit(1), F.size("b") - 1), lambda i, k: F.struct(F.get("w", i).alias("term"), (F.get("b", k + 1) - i).cast("long").alias("tf")))
    return rows.select("id", "seq", F.col("dl").cast("long").alias("dl"), F.explode(runs).alias("r")).select("r.term", "id", "seq", "dl", "r.tf")


class StoredIndex(Bm25Index):
    """What bm25.search() takes, over stored postings."""

    def __init__(self, spark: SparkSession, path: str, okapi: bool = False, tokenizer: Callable[[Column], Column] = tokens):
        self.spark, self.path, self.okapi, self.tokenizer = spark, path, okapi, tokenizer

    # ------------------------------------------------------------------ writing

    def add(self, docs: DataFrame, batch: str) -> None:
        """Adds docs (id, text, seq) whose id the index lacks, each id once: of several rows of
        an id that of the least seq. Who is added is found without the texts; those that are
        added are shuffled, once, only if others are not."""
        name = f"b_{batch}"  # never read as a number
        split = self.tokenizer(F.coalesce("text", F.lit("")))
        key = F.struct("id", "seq", F.xxhash64("text").alias("h"))
        aside = scratch.folder(self.spark, "lengths")
        rows = docs.select(key.alias("k"), F.size(split).cast("long").alias("dl")).groupBy("k.id").agg(F.min(F.struct("k.seq", "k.h", "dl")).alias("r"), F.count(F.lit(1)).alias("n"))
        rows = rows.select("id", "r.seq", "r.h", "r.dl", "n")
        if table_exists(self.spark, f"{self.path}/docs"):
            held = self.docs().filter(F.col("batch") != name).select("id", F.lit(True).alias("held")).distinct()
            rows = rows.join(held, "id", "left")
        else:
            rows = rows.withColumn("held", F.lit(None).cast("boolean"))
        rows.write.parquet(aside)
        all_ = self.spark.read.schema(rows.schema).parquet(aside)
        new, texts = all_.filter("held is null"), docs.select("id", "seq", "text")
        if not all_.filter("held or n > 1").isEmpty():
            texts = among(docs.select(key.alias("k"), "id", "seq", "text"), new.select(F.struct("id", "seq", "h").alias("k")), ["k"]).dropDuplicates(["k"])
        counted = term_counts(texts.select("id", "seq", split.alias("w")))
        self._write(counted.withColumn("bucket", bucket(F.col("term"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "seq"), "postings", name, "bucket")
        own = self._read("postings").filter(F.col("batch") == name)
        self._write(own.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term"), "terms", name, "bucket")
        self._write(new.select("id", "seq", "dl"), "docs", name)  # this makes the batch count
        scratch.remove(self.spark, aside)

    def _write(self, rows: DataFrame, table: str, batch: str, *by: str) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *by).parquet(f"{self.path}/{table}")

    # ------------------------------------------------------------------ reading

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}")

    def docs(self) -> DataFrame:
        return self._read("docs")

    def _complete(self, table: str) -> DataFrame:
        batches = [r["batch"] for r in self.docs().select("batch").distinct().collect()]  # one for each add()
        return self._read(table).filter(F.col("batch").isin(batches))

    @property
    def corpus(self) -> DataFrame:
        n = F.count(F.lit(1))
        return self.docs().agg(n.alias("n"), (F.sum("dl") / F.greatest(n, F.lit(1))).alias("avgdl"))

    def _named(self, rows: DataFrame, wanted: DataFrame) -> DataFrame:
        """Rows of the wanted terms (term), by folder, then by name."""
        asked = wanted.select("term", bucket(F.col("term")).alias("bucket")).distinct()
        some = asked.limit(NAMED_TERMS + 1).collect()
        if len(some) <= NAMED_TERMS:
            return rows.filter(F.col("bucket").isin([r["bucket"] for r in some]) & F.col("term").isin([r["term"] for r in some]))
        buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS
        return rows.filter(F.col("bucket").isin(buckets)).join(asked.select("term"), "term", "left_semi")

    def postings_of(self, wanted: DataFrame | None) -> DataFrame:
        rows = self._complete("postings")
        return (rows if wanted is None else self._named(rows, wanted)).select("term", "id", "seq", "dl", "tf")

    def counts(self) -> DataFrame:
        return self._summed(self._complete("terms"))

    def counts_of(self, postings: DataFrame, wanted: DataFrame) -> DataFrame:
        return self._summed(self._named(self._complete("terms"), wanted))

    def searched(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        postings = self.postings_of(wanted)
        return postings, self.counts_of(postings, wanted), self.corpus

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("term").agg(F.sum("df").alias("df"))
