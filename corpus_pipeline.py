"""Corpus preparation: the stages in order, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunegrid.llm.bpe import encode_documents
from tunegrid.llm.common import release, staged, table
from tunegrid.llm.decontaminate import drop_contaminated
from tunegrid.llm.langid import predict_language, train, training_sample
from tunegrid.llm.near_dup import drop_near_duplicates
from tunegrid.llm.queries import word_tokenizer
from tunegrid.llm.secrets import redact_secrets


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; learned from a bounded sample of the labelled ones.

    Null, empty and letterless texts go. Rows are judged each for itself, so repeated rows and null ids stay or go by
    their text; a null language only takes the row out of the sample. Ties between languages go to the first in order.
    An empty table stays empty; other columns pass through.
    """
    model = train(training_sample(docs, "text", "lang", "doc_id"))  # None without labels: only texts without letters go
    names = ("__tg_lang", "__tg_score", "__tg_entropy", "__tg_rejected")
    return predict_language(docs, model, names=names).where("not __tg_rejected").drop(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the least id.

    Null and empty texts are nobody's copies and stay, as do all rows with a null id; of rows repeating an id one stays, the
    least by text and then by its other columns. An empty table stays empty; other columns pass through.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay. Rows repeating an id go together if one of them holds an item; rows with a
    null id are judged by their own text. An empty table or benchmark changes nothing; other columns pass through.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars counts the text as it now is.

    Null texts stay null with a null n_chars, empty ones empty. Every row stays, repeated rows and null ids too; which random
    tokens count as secrets is decided over all rows. An empty table stays empty; other columns pass through.
    """
    done = redact_secrets(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): each document's token ids, with the digests of the ids and of their decoding.

    The last stage: text, language and source have served and are left out. A null or empty text has no tokens; repeated
    rows and null ids each give a row; an empty table gives none.
    """
    return encode_documents(docs, word_tokenizer(), full=True).drop("decoded")


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("BPE encoding and decoding", encoding),
]
#: Signatures, language models and BPE are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"stage{k}")
            if before is not None:
                release(before)
            before = docs
    return docs
