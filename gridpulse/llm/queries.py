"""One registered query per operator, over its whole table, and DuckDB SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.llm import (classifier, decontaminate, html_content, licenses, oracles, packing, pii, prefix_trie,
                           quality_rules, secret_scan, simhash, token_align, token_count, warc)
from gridpulse.session import cut_lineage

TOKENIZER_FILE = "byte_bpe_50k.json"
PIECE_FILE = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    """Where the installed vocabulary files lie; the same on all executors."""
    import public_tokenizers
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan_pii(table(spark, sf_dir, "documents"))
    return found.withColumn("n_added", F.size("added").cast("long")).drop("base", "added")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.template_table(spark))
    return found.select("key.doc_id", F.size("found").cast("long").alias("n_licenses"),
                        F.array_join(F.transform("found", lambda m: m["template_id"]), ",").alias("licenses"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.extract_pages(table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "key.doc_id", "n_words", F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(secret_scan.span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secret_scan.span_text(F.concat("base", "added")).alias("spans"))


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = classifier.fit_quality(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(classifier.fold(F.col("doc_id")) == 1, F.lit(False))
    return classifier.score_documents(docs, model, ["doc_id"]).select("doc_id", held.alias("held_out"), "score", "predicted")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The table says nothing about times: page n counts as captured n seconds after the epoch.
    found = warc.capture_histories(table(spark, sf_dir, "pages"), time=F.timestamp_seconds("page_id"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path(PIECE_FILE))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = cut_lineage(prefix_trie.ordered_turns(table(spark, sf_dir, "conversations")), "conversations")
    return prefix_trie.prefix_trie(*prefix_trie.share_heads(turns))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_pii, op2_license_scan, op3_quality_rules, op4_html_content, op5_simhash, op6_decontaminate, op7_secret_scan,
    op8_token_count, op9_quality_classifier, op10_packing, op11_warc,
    op12_token_alignment, op13_prefix_trie)}
ORACLES: dict[str, str] = {
    "op2_license_scan": oracles.licenses(licenses.TEMPLATES), "op3_quality_rules": oracles.QUALITY_RULES,
    "op6_decontaminate": oracles.DECONTAMINATE, "op7_secret_scan": oracles.SECRETS, "op11_warc": oracles.WARC,
    "op13_prefix_trie": oracles.PREFIX_TRIE}
