"""The registered queries of this subpackage: each operator over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coocatlas.llm import (
    host_reputation, html_text, hyperminhash, language_id, maxent_lm, merkle, packing, personal_data, preference, prefix_trie, quality_rules, sharding,
    suffix_search,
)
from coocatlas.llm.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents with the verdict of the current policy."""
    rows = quality_rules.ledger(read(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", *quality_rules.MEASURES[:5], (~quality_rules.passes("v1")).alias("base_failed"),
        quality_rules.passes().alias("kept"), F.col("failures").alias("failure_bits"),
    )


@query
def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule does to each policy, over all documents."""
    return quality_rules.ablations(quality_rules.ledger(read(spark, sf_dir, "documents")))


HOST_RULES = (
    host_reputation.Rule("org", "/", "allow"),
    host_reputation.Rule("example.org", "/es/", "block"),
    host_reputation.Rule("example.org", "/en/1", "block"),
    host_reputation.Rule("com", "/fr/", "allow"),
    host_reputation.Rule("com", "/de/", "block"),
)


@query
def op10_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages; an outcome is the quality label of the document that a path's number names."""
    pages, labels = read(spark, sf_dir, "pages").select("page_id", "url"), read(spark, sf_dir, "labels")
    number = F.regexp_extract(host_reputation.path_of(F.col("url")), r"^/[^/]*/([0-9]{1,18})", 1)
    named = pages.select("url", number.alias("number")).where("number <> ''")
    named = named.select("url", F.col("number").cast("bigint").alias("doc_id"))
    outcomes = named.join(labels.select("doc_id", F.col("quality").alias("good")), "doc_id").select("url", "good")
    return host_reputation.judge(pages, outcomes, HOST_RULES).select("page_id", "host", "path", "rule", "verdict")


@query
def op7_differencing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes, equal texts together."""
    rows = sharding.shard_documents(read(spark, sf_dir, "documents"), shards=40)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


@query
def op9_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 along the curve; the ids are given by their checksum."""
    pieces = packing.pack(
        read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op2_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


@query
def op8_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of all documents, every item searched."""
    documents, benchmark = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark")
    rows = suffix_search.search(documents, benchmark)
    return rows.select(
        "doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("found.items"), ",").cast("binary"), 256).alias("items_sha256"),
        suffix_search.contaminated().alias("contaminated"), "found.longest", "found.longest_start", "found.longest_item",
    )


@query
def op6_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    rows = hyperminhash.components(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


@query
def op1_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under the model trained on those outside fold 0."""
    return maxent_lm.score(read(spark, sf_dir, "documents").select("doc_id", "text"))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query
def op5_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: base spans by digest, all spans in full."""
    rows = personal_data.spans(read(spark, sf_dir, "documents").select("doc_id", "text"))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [number(kind) for kind in personal_data.KINDS]
    digest = F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256")
    return rows.select("doc_id", *counts, digest, _joined("spans").alias("spans"))


@query
def op3_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and masked completions of every conversation that has an assistant turn."""
    pairs = preference.format_pairs(preference.replies_as_pairs(read(spark, sf_dir, "conversations")))

    def shown(mask: str) -> Column:
        return F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(mask)

    return pairs.select(
        F.col("pair_id").alias("conv_id"), "n_common", "prompt", "chosen", shown("chosen_mask"), "rejected", shown("rejected_mask"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves and proofs of all documents; every seventh key is audited with one character too many."""
    number = F.col("n_chars").cast("decimal(20,0)") + 1
    return merkle.manifest(
        read(spark, sf_dir, "documents"), {"n_chars": number}, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


@query
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from the labelled ones outside fold 2."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    return language_id.identify(read(spark, sf_dir, "documents"), F.coalesce(fold == 2, F.lit(False)))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the head of the first one of its hundred."""
    conv = F.col("conv_id")
    return prefix_trie.build(
        read(spark, sf_dir, "conversations"), conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6)
