"""The operators of this package as queries over the supplied tables."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from ..sources.sample_views import table
from . import (
    bpe, decontaminate, hard_negatives, language, line_dedup, order_minhash, packing, prefix_trie, quality, secrets,
    segment_search, token_files, url_filter)

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _documents(spark, sf):
    return table(spark, sf, "documents")


def op1_quality_rules(spark, sf):
    docs = _documents(spark, sf)
    return quality.judge_by_labels(docs, table(spark, sf, "labels")).drop("score")


def op2_near_duplicates(spark, sf):
    return order_minhash.near_duplicates(_documents(spark, sf))


def op3_url_filters(spark, sf):
    return url_filter.judge(table(spark, sf, "pages"))


def op4_language_id(spark, sf):
    docs = _documents(spark, sf)
    model = language.fit(docs.where(~language.held_out("doc_id")))
    done = language.predict(docs, model)
    return done.select(
        "row.doc_id", language.held_out("row.doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op5_bpe(spark, sf):
    done = bpe.digests(_documents(spark, sf), TOKENIZER)
    return done.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_line_dedup(spark, sf):
    done = line_dedup.drop_shared_lines(_documents(spark, sf))
    return done.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_packing(spark, sf):
    return packing.pack(packing.measured(_documents(spark, sf)))


def op8_token_files(spark, sf):
    return token_files.written(_documents(spark, sf), TOKENIZER).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_secret_scans(spark, sf):
    docs = _documents(spark, sf)
    return secrets.digest(secrets.scan(docs, secrets.fit(docs)))


def op10_exact_topk(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", segment_search.scaled("embedding").alias("v"))
    return segment_search.top_inner_products(vectors, F.col("vec_id") % 50 == 0)


def op11_decontamination(spark, sf):
    return decontaminate.digests(decontaminate.scan(_documents(spark, sf), table(spark, sf, "benchmark")))


def op12_prefix_trie(spark, sf):
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf, "conversations")))


def op13_hard_negatives(spark, sf):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf, "embeddings").select(
        "vec_id", label.alias("label"), segment_search.scaled("embedding").alias("v"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0)


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_near_duplicates, op3_url_filters, op4_language_id, op5_bpe, op6_line_dedup,
    op7_packing, op8_token_files, op9_secret_scans, op10_exact_topk, op11_decontamination, op12_prefix_trie,
    op13_hard_negatives)}
