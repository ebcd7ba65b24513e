"""Registered queries of the text operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texelyard.llm import bytecnn, decontam, fillmiddle, hilbert, packing, pieces, resampling, rules, secrets, simhash, tokencache, tokenfile, urltree
from texelyard.llm.common import table
from texelyard.session import new_folder


def op1_token_files(spark: SparkSession, d: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    tokenfile.write_token_files(table(spark, d, "documents"), folder, "byte_bpe_50k.json", end_id=2)
    return tokenfile.read_token_digests(spark, folder)


def op2_aho_decontamination(spark: SparkSession, d: str) -> DataFrame:
    found = decontam.find_leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))
    return decontam.leak_digest(found)


URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op3_url_templates(spark: SparkSession, d: str) -> DataFrame:
    """A page shows the document that the last number of its path names; that document's quality labels the url."""
    pages = table(spark, d, "pages").select("page_id", "url")
    shown = F.regexp_extract(urltree.path(F.col("url")), r"([0-9]{1,18})(\.[A-Za-z0-9]+)?/?$", 1)
    named = pages.select("url", F.when(shown != "", shown).cast("long").alias("doc_id"))
    quality = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = named.join(quality, "doc_id").select("url", (F.col("quality") == 0).cast("int").alias("bad"))
    return urltree.judge_urls(pages, labelled, URL_RULES)


def op4_byte_cnn_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    net = bytecnn.fit_network(docs, table(spark, d, "labels"))
    return bytecnn.score_digest(bytecnn.score_documents(docs, net), threshold=0.3)


def op5_vp_tree_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, d, "documents"))


def op6_cached_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokencache.count_tokens(table(spark, d, "documents"), new_folder(spark, "token-cache"), "byte_bpe_50k.json", limit=1024)


def op7_retrieval_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), 2048, "byte_bpe_50k.json", end_id=1, with_ids=False)


def op8_assignment_secrets(spark: SparkSession, d: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, d, "documents").select("doc_id", "text"), mark=None)
    return secrets.secret_digest(found)


def op9_hilbert_shards(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    keep = {
        "doc_id": F.col("doc_id"),
        "size": (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"),
        "text_crc32": F.crc32(F.coalesce(text, F.lit("")).cast("binary")),
    }
    placed = hilbert.curve_shards(table(spark, d, "documents"), 8, keep=keep)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def op10_boosted_rules(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    forest = rules.fit_rules(docs, table(spark, d, "labels"))
    return rules.rule_digest(rules.judge(docs, forest))


def op11_fenwick_fill_middle(spark: SparkSession, d: str) -> DataFrame:
    return fillmiddle.fill_digest(fillmiddle.fill_in_middle(table(spark, d, "documents"), seed=1, plain_percent=10, suffix_first_percent=20))


def op12_crc_resampling(spark: SparkSession, d: str) -> DataFrame:
    return resampling.resample(table(spark, d, "documents"), table(spark, d, "benchmark"), percent=25, seed=7)


def op13_backtracking_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.piece_digest(pieces.encode_pieces(table(spark, d, "documents"), "piece_bpe_32k.model", end_id=2))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_aho_decontamination": op2_aho_decontamination,
    "op3_url_templates": op3_url_templates,
    "op4_byte_cnn_quality": op4_byte_cnn_quality,
    "op5_vp_tree_simhash": op5_vp_tree_simhash,
    "op6_cached_token_counts": op6_cached_token_counts,
    "op7_retrieval_packing": op7_retrieval_packing,
    "op8_assignment_secrets": op8_assignment_secrets,
    "op9_hilbert_shards": op9_hilbert_shards,
    "op10_boosted_rules": op10_boosted_rules,
    "op11_fenwick_fill_middle": op11_fenwick_fill_middle,
    "op12_crc_resampling": op12_crc_resampling,
    "op13_backtracking_pieces": op13_backtracking_pieces,
}
