"""The numbered queries over a folder of tables, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .bpe import decode, encode
from .classifier import classify, fit
from .common import table
from .dac import read_documents, write_dac
from .decontaminate import contamination
from .license_scan import license_scan
from .line_dedup import repeated_lines
from .minhash import near_duplicates
from .packing import best_fit_packing
from .prefix_trie import prefix_trie, rebuilt
from .quality_rules import quality_rules
from .spelling import spelling_variants
from .warc import read_warc, write_warc
from .winnow import edited_likeness


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_dac(table(spark, sf_dir, "documents"))).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = best_fit_packing(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_warc(write_warc(table(spark, sf_dir, "pages")), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decode(encode(table(spark, sf_dir, "documents")))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations"))).drop("node", "parent")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_output, op2_best_fit_packing, op3_line_dedup, op4_minhash_near_dedup, op5_license_scans, op6_quality_rules, op7_warc, op8_winnowing, op9_byte_bpe, op10_quality_classifier,
                           op11_spelling_variants, op12_decontamination, op13_prefix_trie)
}

ORACLES: dict[str, str] = {"op11_spelling_variants": oracles.SPELLING, "op12_decontamination": oracles.DECONTAMINATION, "op13_prefix_trie": oracles.PREFIX_TRIE}
