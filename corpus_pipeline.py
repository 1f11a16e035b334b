"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Every stage but the last returns the columns of documents and works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm import langid, minhash, packing, quality, substrings
from hopweave.storage import materialize

#: Below this posterior no language is said to be known.
LEAST_LANGUAGE_SCORE = 0.5


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# All stages: rows are taken as they come; rows that repeat a doc_id or have none are documents of their own unless a stage says otherwise, every column of
# documents comes back whatever its name, null texts count as empty, and an empty table gives an empty table.


def _scored(docs: DataFrame, score) -> DataFrame:
    """score(docs) where all columns of docs but text have names that score cannot clash with; _back gives them their names again."""
    return score(docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns if c != "text"}))


def _back(scored: DataFrame, columns: list[str]) -> DataFrame:
    return scored.select(*[F.col("text" if c == "text" else f"own_{c}").alias(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), and those of no language that stands out, go. The model is fitted on rows with a doc_id and a lang; where there are none, all go."""
    model = langid.fit(docs, _tokenizer())
    scored = _scored(docs, lambda d: langid.predict(d, model))
    return _back(scored.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)), docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier of quality 0 go. Labels of ids that docs lacks, and null labels, count for nothing; without any label all documents stay."""
    weights = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _back(_scored(docs, lambda d: quality.score(d, weights)).where("predicted = 1"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8) the smallest doc_id stays, with all rows that repeat it; documents without an id or words stay."""
    gone = materialize(minhash.minhash_components(docs.select("doc_id", "text"), size=5, percent=80).where("not kept").select("doc_id").distinct(), "pipeline-gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings are cut from the texts; what is left of characters that were cut in two goes too. n_chars follows, every document stays, null texts become empty."""
    out = substrings.dedup_substrings(docs, as_text=True)
    fields = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*[fields.get(c, F.col(f"extra.`{c}`")).alias(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed token pieces of what is left: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack_documents(docs, _tokenizer())


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]
#: Two stages are learned classifiers, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
