"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickvet.llm import bestfit, edit_decontam, ftrl, importance, linejoin, linkrank, metricjoin, oph, ppm, simhash, tokenalign, unigram_count, whiten

BPE_FILE, UNIGRAM_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
PIECE_FILE = UNIGRAM_FILE


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark, sf_dir):
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2(spark, sf_dir):
    return unigram_count.count_tokens(_table(spark, sf_dir, "documents"), vocabulary(UNIGRAM_FILE))


def op3(spark, sf_dir):
    return linkrank.judge(_table(spark, sf_dir, "pages"))


def op4(spark, sf_dir):
    return edit_decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5(spark, sf_dir):
    return oph.digest(_table(spark, sf_dir, "documents"))


def op6(spark, sf_dir):
    return ppm.predictions(_table(spark, sf_dir, "documents"))


def op7(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    gone = "removed_" + "_".join(docs.columns)  # no column's name
    cleaned = linejoin.dedup_lines(docs, removed=gone)
    return cleaned.select("doc_id", F.size(gone).cast("long").alias("n_removed"), F.array_join(gone, ",").alias("removed"), F.sha2("text", 256).alias("text_sha256"))


def op8(spark, sf_dir):
    return bestfit.pack(_table(spark, sf_dir, "documents"), vocabulary(BPE_FILE))


def op9(spark, sf_dir):
    return ftrl.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10(spark, sf_dir):
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11(spark, sf_dir):
    return metricjoin.groups(_table(spark, sf_dir, "documents"))


def op12(spark, sf_dir):
    return whiten.whiten(_table(spark, sf_dir, "embeddings"))


def op13(spark, sf_dir):
    return tokenalign.align(_table(spark, sf_dir, "documents"), vocabulary(BPE_FILE), vocabulary(PIECE_FILE))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_importance_resampling": op1,
    "op2_unigram_token_count": op2,
    "op3_url_link_trust": op3,
    "op4_edit_decontamination": op4,
    "op5_one_permutation_minhash": op5,
    "op6_ppm_language": op6,
    "op7_line_similarity_join": op7,
    "op8_best_fit_packing": op8,
    "op9_ftrl_toxicity": op9,
    "op10_simhash_vantage": op10,
    "op11_jaccard_metric_join": op11,
    "op12_tsqr_whitening": op12,
    "op13_token_alignment": op13,
    "pipeline": pipeline,
}

SQL = {"op3_url_link_trust": linkrank.judge_sql(), "op7_line_similarity_join": linejoin.dedup_sql()}
