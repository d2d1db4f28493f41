"""The registered queries of the corpus operators."""

from __future__ import annotations

from secrets import token_hex

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunegrid.llm.bpe import encode_documents
from tunegrid.llm.common import table
from tunegrid.llm.conversations import ORACLE as CONVERSATION_ORACLE
from tunegrid.llm.conversations import damaged, repair_conversations, summaries
from tunegrid.llm.decontaminate import contaminated
from tunegrid.llm.embedding_join import embedding_near_duplicates
from tunegrid.llm.langid import learnable, predict_language, train, training_sample
from tunegrid.llm.licenses import oracle as license_oracle
from tunegrid.llm.licenses import scan_licenses
from tunegrid.llm.near_dup import near_duplicates
from tunegrid.llm.pii import PATTERNS, pseudonymise
from tunegrid.llm.repeats import remove_repeats
from tunegrid.llm.resampling import ORACLE as RESAMPLING_ORACLE
from tunegrid.llm.resampling import importance_resample
from tunegrid.llm.sharding import shard_documents
from tunegrid.llm.secrets import KINDS, find_secrets, span_text
from tunegrid.llm.url_filter import ORACLE as URL_ORACLE
from tunegrid.llm.url_filter import filter_urls


def word_tokenizer() -> str:
    """The public 49k word BPE's place; imported here, as only the driver needs it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), word_tokenizer())


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page counts as labelled where `labels` has its number; low quality and toxicity are the bad outcomes."""
    labels = table(spark, sf_dir, "labels")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Setting that holds the key of the pseudonyms.
PII_KEY = "spark.tunegrid.pii.key"


def pii_key(spark: SparkSession) -> str:
    """The session's key: the one it is given, else one drawn for it alone, whose pseudonyms no other session can link or undo."""
    given = spark.conf.get(PII_KEY, None)
    if given is None and getattr(spark, "_tunegrid_pii_key", None) is None:
        spark._tunegrid_pii_key = token_hex(32)
    return given if given is not None else spark._tunegrid_pii_key


def op8_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark), found_only=True)
    return found.select("doc_id", *[_kind_count("pii", k) for k in PATTERNS], "pii", "text")


def op9_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """held_out is false for a null doc_id, which is not trained on either."""
    docs = table(spark, sf_dir, "documents")
    model = train(training_sample(learnable(docs), "text", "lang", "doc_id"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return predict_language(rows, model, "text", ["doc_id", "held_out"])


def _kind_count(column: str, kind: str) -> Column:
    return F.size(F.filter(column, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op10_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    names = [name for name, *_ in KINDS]
    return found.select(
        "doc_id",
        *[_kind_count("secrets", n) for n in names],
        F.sha2(span_text(F.filter("secrets", lambda x: x["kind"].isin(names))), 256).alias("base_sha256"),
        span_text(F.col("secrets")).alias("spans"),
    )


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target distribution is that of all `benchmark` texts."""
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(repair_conversations(damaged(table(spark, sf_dir, "conversations"))))


QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_spaced_seed_decontamination": op2_spaced_seed_decontamination,
    "op3_bpe_encode_decode": op3_bpe_encode_decode,
    "op4_url_reputation": op4_url_reputation,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_license_sentences": op6_license_sentences,
    "op7_histogram_sharding": op7_histogram_sharding,
    "op8_feistel_pii": op8_feistel_pii,
    "op9_kneser_ney_langid": op9_kneser_ney_langid,
    "op10_randomness_secrets": op10_randomness_secrets,
    "op11_suffix_array_dedup": op11_suffix_array_dedup,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES = {"op4_url_reputation": URL_ORACLE, "op6_license_sentences": license_oracle(), "op12_importance_resampling": RESAMPLING_ORACLE, "op13_conversation_repair": CONVERSATION_ORACLE}
