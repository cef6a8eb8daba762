"""The operators applied to the sample tables, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from basketry.llm import (
    bpe,
    conversations,
    jaccard,
    line_dedup,
    near_dedup,
    packing,
    pii,
    product_codes,
    suffix_dedup,
    topk,
    toxicity,
    url_filter,
    warc,
)
from basketry.llm import sql
from basketry.llm.common import prepare

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded again."""
    docs = table(spark, sf_dir, "documents")
    vocabulary = bpe.Vocabulary(spark, RANKS, public_tokenizers.PATTERN)
    ids = docs.select("doc_id", bpe.encode(F.col("text"), vocabulary).alias("ids"))
    both = ids.select("doc_id", "ids", bpe.decode(F.col("ids"), vocabulary).alias("decoded"))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class its near duplicates make."""
    docs = table(spark, sf_dir, "documents")
    done = jaccard.similar_documents(docs, "doc_id", "text", words=5, percent=75)
    return done.select(F.col("doc").alias("doc_id"), "n_shingles", "component_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: base patterns, and what the field adds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = pii.learn(docs, "doc_id", "text")
    found = docs.select("doc_id", pii.find(F.col("text"), model).alias("found")).select("doc_id", "found.*")

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans")
    )


def packed(
    spark: SparkSession,
    docs: DataFrame,
    with_ids: bool = False,
    together: int = packing.TOGETHER_BYTES,
    **options,
) -> DataFrame:
    """Pieces of tokenised documents in sequences of 2048, with the checksum of their ids."""
    tokens = packing.Tokens(spark, TOKENIZER, public_tokenizers.PATTERN, end_id=1, added_tokens=True, **options)
    return packing.pack(docs, "doc_id", "text", tokens, size=2048, with_ids=with_ids, together=together)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and packed."""
    return packed(spark, table(spark, sf_dir, "documents"))


def fold() -> Column:
    """Fold of a row; rows of fold 0 are held out from learning."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Learned from the labelled rows of all folds but the held-out one."""
    labels = table(spark, sf_dir, "labels").where(fold() != 0)
    return toxicity.learn(docs, labels, "doc_id", "text", "toxic")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of being toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(spark, docs, sf_dir)
    scored = docs.select(
        "doc_id", (fold() == 0).alias("held_out"), toxicity.score(F.col("text"), model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    archives = warc.write_archives(table(spark, sf_dir, "pages"), "page_id", "url", "html", min_bytes=0)
    return warc.read_archives(archives).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


#: The rules of the query.
URL_RULES = [
    url_filter.Rule("com", "/", True),
    url_filter.Rule("example.com", "/en/", False),
    url_filter.Rule("www.example.com", "/en/", True),
    url_filter.Rule("net", "/es/", False),
    url_filter.Rule("net", "/fr/", False),
]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's address judged by rules, or else by the language models."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge(pages, "page_id", "url", URL_RULES)
    verdict = F.when(F.col("allowed"), "allow").otherwise("block").alias("verdict")
    return judged.select("row.page_id", "host", "path", "rule", verdict, "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best matches of every 50th vector among all."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, "vec_id", "embedding", F.col("vec_id") % 50 == 0, k=5, scale=256)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links and class among those of its label."""
    vectors = table(spark, sf_dir, "embeddings")
    done = near_dedup.near_duplicates(vectors, "vec_id", "embedding", "label", limit=0.98)
    return done.select("row.vec_id", "n_links", "component_id", "kept")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that others hold."""
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), "doc_id", "text", min_chars=10)
    return done.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's four-byte code, and what is lost by it."""
    vectors = table(spark, sf_dir, "embeddings")
    done = product_codes.encode(vectors, "vec_id", "embedding", "label", parts=4, entries=256, rounds=4)
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return done.select("row.vec_id", code.alias("code"), "error", "label_error", "codebooks_sha256")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 100-byte strings that start earlier too."""
    done = suffix_dedup.dedup_passages(table(spark, sf_dir, "documents"), "doc_id", "text", length=100)
    return done.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged, then repaired."""
    turns = table(spark, sf_dir, "conversations")
    names = ["conv_id", "turn", "role", "text"]
    damaged = conversations.damage(turns, *names)
    done = conversations.repair(damaged, "conversation", "turn", "role", "text").summary
    every = turns.select("conv_id").distinct()
    joined = every.join(done, F.col("conv_id").eqNullSafe(F.col("conversation")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        "conv_id",
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_jaccard": op2_jaccard,
    "op3_pii": op3_pii,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_warc": op6_warc,
    "op7_url_filter": op7_url_filter,
    "op8_topk": op8_topk,
    "op9_near_dedup": op9_near_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_codes": op11_codes,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_conversations": op13_conversations,
}

ORACLE_SQL: dict[str, str] = {
    "op8_topk": sql.TOP_K,
    "op9_near_dedup": sql.NEAR_DEDUP,
    "op10_line_dedup": sql.LINE_DEDUP,
    "op11_codes": sql.PRODUCT_CODES,
    "op12_suffix_dedup": sql.SUFFIX_DEDUP,
}
