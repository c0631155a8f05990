"""The ``opN_<name>`` queries: each applies its operator to its whole table and derives the contract's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sylva.llm import ann, context_tree, conversations, decontaminate, lexical, line_dedup, packing, quality, secret_scan, simhash, substring_dedup, token_store, url_filter
from sylva.llm.common import scratch_path
from sylva.llm.url_filter import Rule

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
END_ID = 0
GOOD_SCORE = 0.7

SITE_RULES = [Rule("com/", "allow"), Rule("example.com/en/", "block"), Rule("www.example.com/en/", "allow"), Rule("net/es/", "block"), Rule("net/fr/", "block")]
PATTERN_RULES = [Rule(f"^{name}^", "block", "pattern") for name in ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every text; learns from labelled rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), ~_held_out(F.col("id")))
    scored = quality.score(docs, model)
    return scored.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD_SCORE).cast("int").alias("predicted"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes later repeats of runs of three lines or more."""
    left = line_dedup.remove_repeated_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"), run=3)
    return left.select("doc_id", "lines.n_lines", "lines.n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds secrets in every text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.find_secrets(docs, RANKS, public_tokenizers.PATTERN)
    base = F.filter("secrets", lambda s: s.kind != "random")
    number = [secret_scan.count_of("secrets", k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *number, F.sha2(secret_scan.joined(base).cast("binary"), 256).alias("base_sha256"), secret_scan.joined("secrets").alias("spans"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks the documents that hold benchmark passages."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, _table(spark, sf_dir, "benchmark")).select("doc_id", "hits.*")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids as compressed planes, reads the files back."""
    path = scratch_path(spark, "token-store")
    token_store.write_tokens(_table(spark, sf_dir, "documents"), path, VOCABULARY, END_ID, literal=False)
    return token_store.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes runs of 35 words that occur twice or more."""
    left = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), window=35)
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest by cosine for every vector whose id 50 divides."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every page's URL."""
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), SITE_RULES + PATTERN_RULES).select("page_id", "judged.*")


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 2048 tokens."""
    return packing.best_fit(_table(spark, sf_dir, "documents"), VOCABULARY, capacity=2048, end_id=END_ID, literal=False)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles, linked at 3 or fewer differing bits."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, bits=3)


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 20)


def _damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage to conversations, by a checksum of conversation and turn."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(text["conv_id"], F.lit(":"), text["turn"]).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", text["role"].alias("role"), text["text"].alias("text"), kind.alias("kind")).where("kind != 0")
    new = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), new.alias("text"), copies.alias("copy")).drop("copy")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of damaged conversations and their cheapest repair."""
    rows = _table(spark, sf_dir, "conversations")
    found = conversations.summaries(conversations.plan(conversations.mark(_damaged(rows))))
    every = rows.select("conv_id").distinct()
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return (every.join(found, every.conv_id.eqNullSafe(found.conv), "left")
            .select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")))


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of every text, learned from the rows that are not held out; a null id is not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return context_tree.score(docs, ~held).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes")


QUERIES = {f.__name__: f for f in (op1_quality, op2_line_dedup, op3_secret_scan, op4_decontaminate, op5_token_store, op6_substring_dedup, op7_ann, op8_url_filter, op9_best_fit, op10_simhash, op11_lexical, op12_conversations, op13_lm_score)}
