"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.llm import chat_format, decontaminate, exact_dedup, hard_negatives, html_extract, license_scan, mixing, near_dedup, quality, sharding, token_files, vector_codes, warc
from weftgraph.llm.common import read_table


def op1_license_scan(spark, sf_dir):
    return license_scan.license_scan(read_table(spark, sf_dir, "documents"))


def op2_chat_format(spark, sf_dir):
    turns = chat_format.with_probe(read_table(spark, sf_dir, "conversations"))
    return chat_format.read_back(chat_format.format_conversations(turns))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op4_near_dedup(spark, sf_dir):
    return near_dedup.near_dedup(read_table(spark, sf_dir, "documents")).drop("_rid", "stays")


def op5_warc(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    return warc.archive_pages(pages).read(pages.select("url")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_decontaminate(spark, sf_dir):
    found = decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("_rid", "spans")


def op7_html_extract(spark, sf_dir):
    return html_extract.extract_text(read_table(spark, sf_dir, "pages"))


def op8_mixing(spark, sf_dir):
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"))


def op9_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, read_table(spark, sf_dir, "labels")))


def op10_sharding(spark, sf_dir):
    return sharding.assign_shards(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op11_vector_codes(spark, sf_dir):
    coded, books = vector_codes.compress_vectors(read_table(spark, sf_dir, "embeddings"))
    return coded.withColumn("codebooks_sha256", F.lit(books.sha256))


def op12_token_files(spark, sf_dir):
    files = token_files.write_tokens(read_table(spark, sf_dir, "documents"))
    return files.read().withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op13_hard_negatives(spark, sf_dir):
    return hard_negatives.mine_hard_negatives(read_table(spark, sf_dir, "embeddings"), label=hard_negatives.shifted_label())


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_chat_format, op3_exact_dedup, op4_near_dedup, op5_warc, op6_decontaminate, op7_html_extract, op8_mixing, op9_quality, op10_sharding, op11_vector_codes,
        op12_token_files, op13_hard_negatives,
    )
}
ORACLES = {
    "op1_license_scan": license_scan.ORACLE,
    "op2_chat_format": chat_format.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op5_warc": warc.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op10_sharding": sharding.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
