"""The registered query of each operator, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from srcmetrics.llm.bpe import token_count
from srcmetrics.llm.conversations import repair_conversations, summaries
from srcmetrics.llm.decontaminate import find_items
from srcmetrics.llm.fingerprint import compare_versions
from srcmetrics.llm.html_text import extract_main_text
from srcmetrics.llm.langid import identify_languages
from srcmetrics.llm.lines import dedup_lines
from srcmetrics.llm.mixing import mix_sources, word_count
from srcmetrics.llm.ngram_join import ngram_components
from srcmetrics.llm.oracle import oracle_sql as oracle_sql
from srcmetrics.llm.packing import pack_documents
from srcmetrics.llm.runs import periodic_runs
from srcmetrics.llm.sharding import shard_documents
from srcmetrics.llm.store import ship
from srcmetrics.llm.warc import read_records, write_archives

Query = Callable[[SparkSession, str], DataFrame]
TOKEN_LIMIT = 1024


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The byte-level vocabulary file of the public tokenizer package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, pct=90)


def op2_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    mixed, _ = mix_sources(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"), 40)


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return identify_languages(docs).select("doc_id", "held_out", "lang_pred", "score")


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_versions(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = write_archives(_table(spark, sf_dir, "pages"))
    return read_records(folder, index, with_payload=False).drop("payload")


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    counted = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        token_count(F.col("text"), vocabulary()).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(_table(spark, sf_dir, "documents"), vocabulary())
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select(*names)


def looped(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth, by a hash of the id, repeat some of their words from a
    place on to the end; these are their words joined by one space. A null id repeats nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    place = chosen.withColumn("a", F.expr("if(size(words) > 0, int(g % size(words)), null)"))
    period = place.withColumn("p", F.expr("int(1 + (size(words) - a) div (3 + g % 8))"))
    repeated = "slice(flatten(array_repeat(slice(words, a + 1, p), int((size(words) - a) div p + 1))), 1, size(words) - a)"
    text = F.when(F.col("a").isNotNull(), F.expr(f"array_join(concat(slice(words, 1, a), {repeated}), ' ')"))
    return period.select("doc_id", F.coalesce(text, F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(looped(_table(spark, sf_dir, "documents")))
    # of equal exponents the first run stays, and runs are in order of start and period
    best = "aggregate(runs, runs[0], (m, r) -> if(r.length * m.period > m.length * r.period, r, m))"
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    return found.withColumn("best", F.expr(f"if(size(runs) > 0, {best}, null)")).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.expr(lines).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with rows that a hash of their place leaves out, empties, leaves without
    ends of sentences, repeats or gives to the user. Nulls are one space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    marked = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("h"))
    hurt = marked.filter("h <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.expr("array_repeat(0, if(h = 3, 2, 1))")).alias("copy"),
    )
    return hurt.drop("copy")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    found = summaries(repair_conversations(damaged(rows))).withColumnRenamed("conv_id", "c")
    ids = rows.select("conv_id").distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return ids.join(found, F.expr("conv_id <=> c"), "left").select(
        "conv_id",
        *[F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_leaks": op2_leaks,
        "op3_mix": op3_mix,
        "op4_line_dedup": op4_line_dedup,
        "op5_shards": op5_shards,
        "op6_main_text": op6_main_text,
        "op7_language": op7_language,
        "op8_fingerprint": op8_fingerprint,
        "op9_warc": op9_warc,
        "op10_tokens": op10_tokens,
        "op11_packing": op11_packing,
        "op12_runs": op12_runs,
        "op13_repair": op13_repair,
        "pipeline": corpus_pipeline.run,
    }
