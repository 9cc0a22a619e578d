"""From raw documents to shards of a training mix.

``run`` applies STAGES in turn; each stage's result is written to the shared folder as Parquet
and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from srcmetrics.llm.decontaminate import decontaminated
from srcmetrics.llm.langid import keep_identified, train
from srcmetrics.llm.mixing import mix_sources, word_count
from srcmetrics.llm.ngram_join import ngram_components
from srcmetrics.llm.sharding import byte_size, shards
from srcmetrics.llm.store import bounded, ship, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: A text is rejected if no language has this calibrated probability: then all others together
#: are as likely.
LEAST_SCORE = 0.5
#: Near copies: words of a shingle and percent of Jaccard similarity.
SHINGLE, SIMILARITY = 5, 80
SHARDS = 40
#: Whole texts, which may be long, are held by so many rows at once on the way to a Python worker
#: and when read, and by so many bytes when written.
LIMITS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": 1000,
    "spark.sql.parquet.columnarReaderBatchSize": 512,
    "parquet.block.size": 16 << 20,
}


def _ready(spark: SparkSession) -> None:
    ship(spark)
    for name, limit in LIMITS.items():
        spark.conf.set(name, min(int(spark.conf.get(name, str(limit))), limit))


def _identity() -> Column:
    """What tells rows apart where ids are null or repeated: rows equal in id and text are the
    same document. It is worked out where a row is read and is the same in every run."""
    return F.xxhash64("doc_id", "text")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents in which no language is recognised: without text, without letters
    or with a score below LEAST_SCORE. The model learns from the rows with a language."""
    _ready(spark)
    return keep_identified(docs, train(docs), LEAST_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: that with the smallest id (null last; equal
    ids by text hash). Rows equal in id and text are copies of one another."""
    _ready(spark)
    rows = docs.select(_identity().alias("key"), "doc_id", "text")
    groups = stored(ngram_components(rows.select(F.col("key").alias("doc_id"), "text"), SHINGLE, SIMILARITY))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    named = rows.groupBy("key").agg(F.min(place).alias("place"), F.count("*").alias("copies"))
    groups = groups.select(F.col("doc_id").alias("key"), "component_id").distinct()
    named = stored(named.join(groups, "key").select("key", "component_id", "place", "copies"))
    first = named.groupBy("component_id").agg(F.min("place").alias("first"), F.count("*").alias("keys")).filter("keys > 1")
    gone = named.join(bounded(stored(first), 64), "component_id").filter("place <> first").select("key")
    repeated = stored(named.filter("copies > 1").select("key"))
    marked = docs.withColumn("_key", _identity())
    kept = marked.join(bounded(stored(gone), 16).withColumnRenamed("key", "_key"), "_key", "left_anti")
    # only rows that repeat others meet one another
    known = bounded(repeated.withColumn("_again", F.lit(True)), 17).withColumnRenamed("key", "_key")
    kept = stored(kept.join(known, "_key", "left"))
    once = kept.filter("_again IS NULL").unionByName(kept.filter("_again").dropDuplicates(["_key"]))
    return once.select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold a test item of ``benchmark``."""
    _ready(spark)
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out whole documents as the mix takes their words: a document stays
    as often as the words taken are its size, to the nearest whole number."""
    _ready(spark)
    mixed, _ = mix_sources(docs.select(_identity().alias("doc_id"), "source", word_count(F.col("text")).alias("size")))
    times = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(0)
    taken = mixed.select(F.col("doc_id").alias("_key"), times.cast("int").alias("_times"))
    taken = stored(taken.groupBy("_key").agg(F.max("_times").alias("_times")).filter("_times > 0"))
    joined = docs.withColumn("_key", _identity()).join(bounded(taken, 16), "_key")
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``shard`` (0 to SHARDS - 1): the mix in order of id, digest and size, dealt to
    shards of near equal bytes. Shards are cut by sizes and digests alone; the texts are told
    their shard by the places of the cuts, as many as there are shards."""
    _ready(spark)
    order = ["doc_id", "crc", "size"]
    keyed = docs.withColumn("_k", F.struct("doc_id", F.crc32(F.encode("text", "UTF-8")).alias("crc"), byte_size(F.col("text")).alias("size")))
    dealt = shards(keyed.select("_k.*"), SHARDS, order)
    firsts = dealt.groupBy("shard").agg(F.min(F.struct(*order)).alias("k")).orderBy("shard").collect()  # a row a shard
    kind = keyed.schema["_k"].dataType
    cuts = [F.struct(F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r.k, kind, strict=True)]).alias("k"), F.lit(r.shard).alias("shard")) for r in firsts]
    if not cuts:
        return docs.withColumn("shard", F.lit(0))
    ahead = F.filter(F.array(*cuts), lambda c: c["k"] <= F.col("_k"))
    return keyed.withColumn("shard", F.array_max(F.transform(ahead, lambda c: c["shard"]))).select(*docs.columns, "shard")


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("mix", mix),
    ("shard", shard),
]

#: The language model and the near copies are beyond SQL; tests/llm/test_pipeline.py holds each
#: stage and ``run`` against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
