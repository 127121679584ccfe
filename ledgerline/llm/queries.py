"""One query per operator, with its production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import (
    best_fit,
    byte_bpe,
    cap_filters,
    collocations,
    entropy_mix,
    learned_partitions,
    lsh_forest,
    naive_bayes,
    pii,
    rule_ensemble,
    spelling,
    transcripts,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return learned_partitions.nearest(embeddings, lambda vec_id: vec_id % 50 == 0, k=5)


def remainder(count: int) -> Column:
    """Folds of documents: crc32 of doc_id as text."""
    return F.crc32(F.col("doc_id").cast("string")) % count


def op2_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    return rule_ensemble.quality(table(spark, sf_dir, "documents", "doc_id", "text"), labels, remainder(5) == 0)


def op3_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive_bayes.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), remainder(3) == 1)


def op4_gzip_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"), min_bytes=0).drop("url")


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by words; texts that differ in case and white space alone are one cluster."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return best_fit.pack(best_fit.items_of(docs))


def op6_candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pii.find(docs, pii.fit(docs))


def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), words=3, percent=85)


def op8_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), cosine=0.9)


def op9_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return transcripts.parse(transcripts.transcripts(conversations), transcripts.fit(conversations))


def op10_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix.mixture(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def slipped(doc_id: Column, word: Column) -> Column:
    """One occurrence in 31, by its hash, loses the letter that the hash points at."""
    h = F.crc32(F.concat(doc_id, F.lit(":"), word))
    at = (h % F.length(word)).cast("int")
    less = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(h % 31 == 0, less).otherwise(word)


def op11_letter_count_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(table(spark, sf_dir, "documents", "doc_id", "text"), 7, 2, slipped)
    return spelling.group_variants(words, times=10)


def op12_count_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents", "text", "lang"), least=30, contained=80, top=2000)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(table(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.PATTERN)


QUERIES: dict[str, Query] = {
    "op1_learned_partitions": op1_learned_partitions,
    "op2_rule_ensemble": op2_rule_ensemble,
    "op3_naive_bayes": op3_naive_bayes,
    "op4_gzip_normaliser": op4_gzip_normaliser,
    "op5_best_fit": op5_best_fit,
    "op6_candidate_boosting": op6_candidate_boosting,
    "op7_lsh_forest": op7_lsh_forest,
    "op8_cap_filters": op8_cap_filters,
    "op9_transcripts": op9_transcripts,
    "op10_entropy_mix": op10_entropy_mix,
    "op11_letter_count_trees": op11_letter_count_trees,
    "op12_count_automata": op12_count_automata,
    "op13_byte_bpe": op13_byte_bpe,
}
