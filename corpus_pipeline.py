"""A training corpus made from ``documents`` in five stages, each written as Parquet and read again.

1. language: rejects documents without a recognisable language (no letters).
2. near_dedup: one document of each group of near-duplicates stays (5-word shingles, likeness 0.8).
3. substring_dedup: passages of ``WINDOW`` words or more that a smaller doc_id holds are cut out; a document of
   which nothing is left goes. Documents without such a passage keep their text as it is.
4. decontaminate: documents that hold a benchmark item go.
5. encode: pieces of every document, decoded again as a proof.

Defined cases are those of the operators: a null text counts as empty (stage 1 rejects it), rows with a null
doc_id are never duplicates, and other columns are carried along, whatever their names; the last stage gives doc_id and
its pieces. An empty table gives empty stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm.decontamination import find_items
from foliomill.llm.language_id import UNKNOWN, fit, predict
from foliomill.llm.minhash_dedup import link_components
from foliomill.llm.piece_encoding import encode_pieces
from foliomill.llm.substring_dedup import dedup_substrings
from foliomill.llm.workspace import Workspace

WINDOW = 25


def _others(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c not in ("doc_id", "text"))


def _restored(docs: DataFrame, text: Column) -> list[Column]:
    """The columns of docs, from rows that carry them."""
    own = {"doc_id": F.col("doc_id"), "text": text}
    return [own.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = predict(spark, docs, fit(spark, docs), _others(docs))
    return rows.filter(F.col("lang_pred") != UNKNOWN).select(*_restored(docs, F.col("text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = link_components(spark, docs).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = dedup_substrings(spark, docs, window=WINDOW, carry=_others(docs))
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept_text")).otherwise(F.col("text"))
    columns = _restored(docs, text)
    if "n_chars" in docs.columns:
        length = F.length(text).cast(docs.schema["n_chars"].dataType)
        columns[docs.columns.index("n_chars")] = F.when(cut, length).otherwise(F.col("carried.n_chars")).alias("n_chars")
    return rows.filter("n_removed = 0 or n_removed < n_words").select(*columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = find_items(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_pieces(spark, docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language", language), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.write(stage(spark, docs, sf_dir), name)
    return docs
