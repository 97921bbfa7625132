"""Registered queries of the training-data operators (thin forms of the operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clickwise.llm import ann, decontaminate, html, license, merkle, oracles, packing, pii, quality, repeats, secret_scan, simhash, toxicity, whitening
from clickwise.llm.common import read


def op1_decontamination(spark, sf_dir):
    return decontaminate.contamination(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


def op2_html(spark, sf_dir):
    return html.main_text(read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op6_neighbours(spark, sf_dir):
    return ann.search(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), every=20, k=20)


def op3_license(spark, sf_dir):
    return license.license_scan(read(spark, sf_dir, "documents", "doc_id", "text"))


def op4_simhash(spark, sf_dir):
    return (simhash.simhash_groups(read(spark, sf_dir, "documents", "doc_id", "text"), shingle=3, max_bits=2)
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def op5_pii(spark, sf_dir):
    return pii.personal_data(read(spark, sf_dir, "documents", "doc_id", "text"))


def op7_repeats(spark, sf_dir):
    return repeats.remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"), length=100).drop("spans")


def op8_toxicity(spark, sf_dir):
    return toxicity.toxicity(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "toxic"))


def op9_quality(spark, sf_dir):
    return quality.quality(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality"))


def op10_packing(spark, sf_dir):
    return packing.pack_documents(read(spark, sf_dir, "documents", "doc_id", "text"))


def op11_whitening(spark, sf_dir):
    return whitening.whitened(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), components=4)


def op12_secrets(spark, sf_dir):
    return secret_scan.secrets(read(spark, sf_dir, "documents", "doc_id", "text"))


def op13_merkle(spark, sf_dir):
    return merkle.manifest(read(spark, sf_dir, "documents", *merkle.FIELDS)).drop("copied")


def queries():
    return {f.__name__: f for f in (op1_decontamination, op2_html, op3_license, op4_simhash, op5_pii, op6_neighbours, op7_repeats, op8_toxicity, op9_quality, op10_packing,
                                    op11_whitening, op12_secrets, op13_merkle)}


def oracle_sql():
    return oracles.oracle_sql()
