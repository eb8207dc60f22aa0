"""Registered queries of the training-data operators: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import table
from sheaf.llm import audit, language, mixing, packing, pieces, repair, secrets
from sheaf.llm.fingerprints import fingerprint_edits
from sheaf.llm.html import extract_pages
from sheaf.llm.lines import dedup_lines
from sheaf.llm.minhash import near_duplicates
from sheaf.llm.substrings import remove_repeats
from sheaf.llm.topk import top_products

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        REGISTRY[name] = fn
        return fn

    return register


@query("op1_merkle_fingerprints")
def op1_merkle_fingerprints(spark, sf_dir):
    """Merkle fingerprints of all documents and of their edited texts, with likenesses."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))


@query("op2_substring_dedup")
def op2_substring_dedup(spark, sf_dir):
    """Words outside all 35-word windows that occur more than once in the whole corpus."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op3_pack_sequences")
def op3_pack_sequences(spark, sf_dir):
    """All documents as token pieces in sequences of at most 1024 tokens."""
    out = packing.pack(packing.pieces(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op4_language_id")
def op4_language_id(spark, sf_dir):
    """Language of every text, learned from two thirds of the labelled documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    models = language.train(docs.where(~held_out))
    out = language.identify(docs, models)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


@query("op5_exact_topk")
def op5_exact_topk(spark, sf_dir):
    """The 20 highest integer inner products for every twentieth vector."""
    return top_products(table(spark, sf_dir, "embeddings"))


@query("op6_secret_scan")
def op6_secret_scan(spark, sf_dir):
    """Secrets in every text: counts and digest of the strong spans, and all spans."""
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    strong = F.filter("spans", lambda x: x["kind"].isin(*secrets.BASE))
    return found.select(
        "doc_id", *map(count, secrets.BASE), F.sha2(secrets.written_out(strong), 256).alias("base_sha256"), secrets.written_out(F.col("spans")).alias("spans")
    )


@query("op7_line_dedup")
def op7_line_dedup(spark, sf_dir):
    """All documents without lines that match an earlier line of the corpus."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op8_minmax_near_dedup")
def op8_minmax_near_dedup(spark, sf_dir):
    """Near-duplicate components of all documents on 4-word shingles at a Jaccard similarity of 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=4)


@query("op9_html_main_text")
def op9_html_main_text(spark, sf_dir):
    """Main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))


@query("op10_mix_sources")
def op10_mix_sources(spark, sf_dir):
    """How many words of each document the weighted mix of all sources takes."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op11_conversation_repair")
def op11_conversation_repair(spark, sf_dir):
    """Damaged conversations repaired at the least cost: report, edits and digest of every conversation."""
    turns = table(spark, sf_dir, "conversations")
    return repair.repaired(turns, repair.damaged(turns))


@query("op12_filter_audit")
def op12_filter_audit(spark, sf_dir):
    """What five filters remove of all documents, in every order, by source."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = audit.failures(docs, audit.text_failures(F.coalesce(docs["text"], F.lit(""))), repeats="E")
    counts = audit.histogram(rows, labels, {"good": labels["quality"] == 1, "toxic": labels["toxic"] == 1})
    return audit.audit_orders(counts, "ABCDE", ("good", "toxic"))


@query("op13_sentencepiece")
def op13_sentencepiece(spark, sf_dir):
    """SentencePiece ids of every text and their decoded text, as digests."""
    out = pieces.encoded(table(spark, sf_dir, "documents"), packing.tokenizer_file("piece_bpe_32k.model"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
