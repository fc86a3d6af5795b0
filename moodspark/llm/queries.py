"""Registered queries of this subpackage, thin over their operators, and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (conversation_repair, exact_dedup, hard_negatives, mixing, packing, page_text, quality, quality_rules, sharding,
               simhash, substring_dedup, toxicity, weighted_sampling)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, at most two differing bits, over all documents."""
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return groups.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


@query("op3_soft_membership_mixing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors, rate and copies of every document for the default target weights."""
    rated = mixing.mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rated.select("doc_id", "tokens", *[rated[f"p{k}"].alias(f"p_{d}") for k, d in enumerate(mixing.DOMAINS)],
                        "rate", "copies")


@query("op4_consistent_weighted_sampling")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return weighted_sampling.edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op5_suffix_automata")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document without those in windows of 13 words that an earlier document has."""
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(kept["kept_text"].cast("binary"), 256).alias("kept_sha256"))


@query("op6_hash_tree_sharding")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 40 shards by their ids, and the shard each would have among 41."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), shards=40)


@query("op7_shortest_pack_first")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into sequences of at most 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


@query("op8_co_training_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by both views and by their combination; those below one half are rejected."""
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", scored["_text_score"].alias("text_score"),
                         scored["_metadata_score"].alias("metadata_score"), scored["_score"].alias("score"),
                         (scored["_score"] >= 0.5).alias("kept"))


@query("op9_exact_dedup", """
    WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                               'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op10_factorization_machine_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labelled rows that are not held out."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op1_nearest_url_differencing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return page_text.extract_text(table(spark, sf_dir, "pages"))


@query("op13_four_russians_negatives", """
    WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
                 list_dot_product(a.v, c.v)::BIGINT AS score
          FROM r a, r c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
                 row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id)::INT AS positive_rank
          FROM s WHERE same QUALIFY positive_rank <= 5)
    SELECT p.anchor_id, positive_id,
           row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score, positive_rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
         AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding; every seventh label is first moved on by one."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_negatives(rows.withColumn("label", moved))


BASE_FACTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@query("op12_rule_cascade", r"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
    word AS (SELECT k, unnest(ws) AS word FROM w),
    per_word AS (SELECT k, sum(length(word)) AS word_chars, sum((NOT regexp_matches(word, '\p{L}'))::INT) AS letterless
                 FROM word GROUP BY k),
    top AS (SELECT k, max(n) AS top_word FROM (SELECT k, count(*) AS n FROM word GROUP BY k, word) GROUP BY k),
    line AS (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d),
    lines AS (SELECT k, sum(n - 1) AS n_dup_lines FROM (
              SELECT k, count(*) AS n FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k, line) GROUP BY k),
    win AS (SELECT k, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS win
            FROM (SELECT k, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
    twice AS (SELECT k, i FROM win QUALIFY count(*) OVER (PARTITION BY k, win) > 1),
    rep AS (SELECT k, count(DISTINCT p) AS n_repeat_words FROM (SELECT k, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY k),
    f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
                 length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                 coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
                 length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_upper, coalesce(letterless, 0) AS letterless,
                 coalesce(top_word, 0) AS top_word, len(string_split(t, chr(10))) AS n_lines
          FROM d JOIN w USING (k) LEFT JOIN per_word USING (k) LEFT JOIN top USING (k) LEFT JOIN lines USING (k)
          LEFT JOIN rep USING (k)),
    b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_upper > 30 * word_chars OR word_chars < 2 * n_words
                OR word_chars > 15 * n_words OR 100 * letterless > 30 * n_words
                OR (100 * n_dup_lines > 30 * n_lines AND n_dup_lines >= 2)
                OR (100 * top_word > 30 * n_words AND n_words >= 20)) AS kept
    FROM b
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the rule cascade for every document."""
    rows = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), always=BASE_FACTS)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select("doc_id", *BASE_FACTS, failed.alias("base_failed"), "kept")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations damaged by crc32 of ``conv_id:turn`` mod 20: row dropped, emptied, unpunctuated, repeated or given role user."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = (F.crc32(key.cast("binary")) % 20).alias("kind")
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind).where("kind <> 0")
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(
            F.col("text")).alias("text"), F.explode(times).alias("copy")).drop("copy")


@query("op11_persistent_audit_dp")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit and repaired hash of every conversation after damage; those without a row left have none."""
    rows = table(spark, sf_dir, "conversations")
    found = conversation_repair.repair(damaged(rows))
    ids = rows.select(F.col("conv_id").cast("bigint").alias("id")).distinct()
    figures = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
               for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), *figures, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
