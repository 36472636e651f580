"""The registered queries of this subpackage: op1 to op13 and the pipeline."""

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from panelfold.llm import (containment, credentials, divergence, mixing, neighbours, ngramjoin, pagetext, passages,
                           phrases, pii, simhash, spans, tokens, urlrules)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op2_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda c: c % 20 == 0)


def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = passages.train(docs, table(spark, sf_dir, "labels"), "quality",
                           allowed=lambda c: ~passages.held_out(c))
    return passages.score(docs, model).select(
        "doc_id", passages.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    labels = (table(spark, sf_dir, "labels").where("doc_id is not null")
              .groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad")))
    shown = pages.select("url", urlrules.document_number().alias("doc_id"))
    labelled = shown.join(labels, "doc_id").select("url", "bad")
    return urlrules.judge(pages, labelled).select("page_id", "host", "path", "rule", "verdict")


def op5_tokens(spark, sf_dir):
    return tokens.round_trip(table(spark, sf_dir, "documents"), tokens.byte_bpe())


def op6_secrets(spark, sf_dir):
    found = credentials.secret_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex",
                        spans.digest(F.col("base"), credentials.KINDS).alias("base_sha256"),
                        spans.listed(F.col("spans"), credentials.KINDS).alias("spans"))


def op7_decontaminate(spark, sf_dir):
    found = containment.contained_items(table(spark, sf_dir, "documents"),
                                        table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "shared", "containment")


def op8_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op9_pagetext(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    labelled = pagetext.training_pages(pages, table(spark, sf_dir, "documents"), urlrules.document_number())
    return pagetext.extract(pages, pagetext.train(labelled))


def op10_pii(spark, sf_dir):
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                        spans.digest(F.col("base"), pii.KINDS).alias("base_sha256"),
                        spans.listed(F.col("spans"), pii.KINDS).alias("spans"))


def op11_divergence(spark, sf_dir):
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_phrases(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_ngramjoin(spark, sf_dir):
    return ngramjoin.join_documents(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {"op1_simhash": op1_simhash, "op2_neighbours": op2_neighbours,
           "op3_quality": op3_quality,
           "op4_urls": op4_urls, "op5_tokens": op5_tokens, "op6_secrets": op6_secrets,
           "op7_decontaminate": op7_decontaminate, "op8_mix": op8_mix,
           "op9_pagetext": op9_pagetext, "op10_pii": op10_pii,
           "op11_divergence": op11_divergence, "op12_phrases": op12_phrases,
           "op13_ngramjoin": op13_ngramjoin,
           "pipeline": pipeline}
SQL = {"op8_mix": mixing.SQL, "op11_divergence": divergence.SQL,
       "op12_phrases": phrases.SQL}
