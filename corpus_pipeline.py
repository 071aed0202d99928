"""A corpus pipeline of five stages, each on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegraph.llm import jaccard_join, mixing, sentencepiece_codec, substring_dedup, toxicity
from tidegraph.llm.entries import table, vocabulary
from tidegraph.llm.support import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the network is fitted on labelled rows outside the held-out fold."""
    net = toxicity.fit_on(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs.select(*COLUMNS), net)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents the one with the smallest id stays."""
    return jaccard_join.one_of_each(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat a document with a smaller id are cut; texts left without words go."""
    return substring_dedup.remove_repeats(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as the mix of sources takes it."""
    return mixing.take_mix(docs.select(*COLUMNS))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, decoded again, as digests."""
    return sentencepiece_codec.encode_documents(docs, vocabulary("piece_bpe_32k.model"), sentencepiece_codec.digests, sentencepiece_codec.DIGESTS)


STAGES = [("toxicity", drop_toxic), ("jaccard_join", one_of_each_group), ("substring_dedup", cut_repeats), ("mixing", mix), ("sentencepiece", encode_pieces)]

#: SQL can express neither the network nor the joins; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared scratch folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
