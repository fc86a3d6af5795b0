"""Document fingerprints by consistent weighted sampling (DataFrame functions only).

A document is a set of weighted terms: its words and how often each occurs.
For each of ``samples`` draws a term of weight w gets, from hashes of (term,
draw) alone, r and c from Gamma(2, 1) and b from Uniform(0, 1), and from them

    t = floor(ln w / r + b),   a = c / exp(r (t - b + 1)).

The term with the smallest a is the sample (with its t). Two documents have
the same sample in a draw with a probability equal to their generalised
Jaccard similarity, sum of min(w, w') over sum of max(w, w'). Since a is a
function of (term, draw, t), equal minima of a mean equal samples; so the
signature is the vector of minima, kept to 16 hash bits per draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import block_of, blocks_for, split_points

SAMPLES = 48
DIGITS = 4


WHITE = " \t\n\x0b\f\r"


def sorted_words(text: Column) -> Column:
    """Sorted hashes of the words, repeats included; words are runs without ASCII white space.

    A text without words has one entry, the hash of the empty word.
    """
    words = F.split(F.btrim(text, F.lit(WHITE)), r"[ \t\n\x0b\f\r]+")
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))


def _uniform(bits: Column, shift: int, width: int) -> Column:
    part = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1))
    return (part.cast("double") + 0.5) * F.lit(2.0 ** -width)


def smallest(k: int) -> Column:
    """The minimum of a over a document's rows (h, lnw) for draw ``k``; -ln(u v) of two uniforms is Gamma(2, 1)."""
    one, two = F.xxhash64(F.col("h"), F.lit(2 * k)), F.xxhash64(F.col("h"), F.lit(2 * k + 1))
    r = -F.log(_uniform(one, 0, 21) * _uniform(one, 21, 21))
    b = _uniform(one, 42, 22)
    c = -F.log(_uniform(two, 0, 32) * _uniform(two, 32, 32))
    return F.min(c * F.exp(r * (b - 1 - F.floor(F.col("lnw") / r + b))))


def signatures(texts: DataFrame, keys: list[str], text_col: str, samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``fingerprint`` for each row of ``texts``; ``keys`` identify the rows and may hold facts about them.

    If ``texts`` is partitioned by some of ``keys``, nothing is shuffled: terms
    are counted within their row, and the minima are grouped where they are.
    """
    # every step is exploded once so that it is a column of its own and not repeated for each element
    hashed = texts.select(*keys, F.explode(F.array(sorted_words(F.col(text_col)))).alias("hs"))
    h, at = F.col("hs"), F.col("at")
    runs = F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: (i == 1) | (F.get(h, i - 1) != F.get(h, i - 2)))
    started = hashed.select(*keys, "hs", F.explode(F.array(runs)).alias("at"))
    ends = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(h) + 1))
    terms = F.zip_with(at, ends, lambda i, j: F.struct(F.get(h, i - 1).alias("h"), (j - i).alias("w")))
    rows = (started.select(*keys, F.explode(terms).alias("t"))
            .select(*keys, F.col("t.h").alias("h"), F.log(F.col("t.w").cast("double")).alias("lnw")))
    least = rows.groupBy(*keys).agg(*[smallest(k).alias(f"a{k}") for k in range(samples)])
    part = [F.lpad(F.lower(F.hex(F.xxhash64(f"a{k}").bitwiseAND(F.lit(16 ** DIGITS - 1)))), DIGITS, "0")
            for k in range(samples)]
    return least.select(*keys, F.concat(*part).alias("fingerprint"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of draws in which two fingerprints agree."""
    same = [(F.substring(a, 1 + DIGITS * k, DIGITS) == F.substring(b, 1 + DIGITS * k, DIGITS)).cast("int")
            for k in range(samples)]
    return sum(same[1:], same[0]) / F.lit(float(samples))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        samples: int = SAMPLES) -> DataFrame:
    """One row per document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text has the last half (rounded down) of the code points
    replaced by the first as many of the next document in order of (id, text),
    null ids first, the first document following the last one. Null texts
    count as empty; all texts without words have one fingerprint. Repeated
    rows follow one another. Further columns are not read; an empty table gives
    no rows.

    Documents are cut into blocks of consecutive ids and shuffled once, by
    block. The first row of a block is also sent to the block before, so every
    document finds the next one in its own block; all later steps keep this
    partitioning.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    points = split_points(rows, "doc_id", blocks_for(spark))
    ends = rows.agg(F.min("doc_id").alias("low"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    first = points + ([] if ends["nulls"] or ends["low"] is None else [ends["low"]])
    last = len(points)
    block = block_of(F.col("doc_id"), points)
    starts = F.split(F.lit(",".join(map(str, first)) or "0"), ",").cast("array<bigint>")
    leads = F.coalesce(F.array_contains(starts, F.col("doc_id")), F.lit(False)) | F.col("doc_id").isNull()
    before = F.when(block == 0, last).otherwise(block - 1)
    sent = rows.select("doc_id", "text", F.explode(F.when(leads, F.array(
        F.struct(block.alias("b"), F.lit(0).alias("lent")), F.struct(before.alias("b"), F.lit(1).alias("lent"))))
        .otherwise(F.array(F.struct(block.alias("b"), F.lit(0).alias("lent"))))).alias("p")).select(
        F.col("p.b").alias("block"), F.col("p.lent").alias("lent"), "doc_id", "text")
    order = W.partitionBy("block").orderBy("lent", F.col("doc_id").asc_nulls_first(), "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (n - half).cast("int")), F.substring("next", F.lit(1), half))
    placed = (sent.withColumns({"row": F.row_number().over(order), "next": F.lead("text").over(order)})
              .select("block", "row", "lent", "doc_id", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited")))
    own = F.struct(F.lit("").alias("sha"), F.col("text").alias("t"))
    other = F.struct(F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), F.col("edited").alias("t"))
    sides = placed.select("block", "row", "lent", "doc_id", "n_chars", F.explode(
        F.when(F.col("lent") == 0, F.array(own, other)).otherwise(F.array(own))).alias("s"))
    facts = ["block", "row", "lent", "doc_id", "n_chars"]
    printed = signatures(sides.select(*facts, F.col("s.sha").alias("sha"), F.col("s.t").alias("text")),
                         [*facts, "sha"], "text", samples)
    # by sha, the text itself (an empty one) comes before its edited text; the next document's rows follow
    mine = W.partitionBy("block").orderBy("row", "sha")
    joined = printed.withColumns({
        "edited_sha256": F.lead("sha").over(mine), "edited_fingerprint": F.lead("fingerprint").over(mine),
        "next_print": F.lead("fingerprint", 2).over(mine)})
    return joined.where("lent = 0 and sha = ''").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.coalesce("next_print", "fingerprint"), samples).alias("near_next"))
