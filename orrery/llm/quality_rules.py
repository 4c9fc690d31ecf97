"""Quality rules: a hashed n-gram log-likelihood ratio beside a few fixed rules.

Unigrams and bigrams of words are hashed into ``buckets``.  Two multinomials
over the buckets are counted: the raw corpus (every row) and a trusted target
(rows that ``labels`` marks with quality 1).  A document's score is the mean of
log p_target - log p_raw over all its n-grams; the document is kept if no fixed
rule fails and the score reaches ``threshold``.  All of it is built-in
functions; the table of log ratios comes back as a literal of ``buckets`` doubles.

The target is fitted on at most ``target_rows`` labelled rows (the ones with
the lowest hash of their id); counts of the raw corpus cover all rows.

Defined results: null text has no words (it fails the rule on length); a
document with no n-gram scores 0; with no labelled rows every ratio would be
meaningless, so the target falls back to the raw corpus and all scores are 0;
equal rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import BLANKS, let, lit_long

# The limits of the contract.
LEAST_WORDS = 50
SYMBOLS = r"[#*$%&|<>]"

BUCKETS = 1 << 15
THRESHOLD = -0.12
TARGET_ROWS = 100_000
#: Occurrences that are added to both counts of a bucket, the target's scaled to the corpus: rare words say little.
SMOOTHING = 10.0


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def repeated_words(hashes: Column, words: Column) -> Column:
    """Words that lie in a 3-word window which occurs twice or more.

    Each window is one long: the high bits of its hash, its position in the low
    bits.  After a primitive sort, equal windows are neighbours; neighbours
    whose high bits agree are compared word by word.
    """
    n = F.size(words)

    def with_bits(bits: Column) -> Column:
        low = F.call_function("shiftleft", lit_long(1), bits) - 1

        def with_low(mask: Column) -> Column:
            packed = F.transform(
                F.sequence(F.lit(0), n - 3),
                lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2))
                .bitwiseAND(F.bitwise_not(mask))
                .bitwiseOR(i.cast("bigint")),
            )

            def with_sorted(p: Column) -> Column:
                place = lambda x: x.bitwiseAND(mask).cast("int")

                def same(x: Column, y: Column) -> Column:
                    equal = x.bitwiseAND(F.bitwise_not(mask)) == y.bitwiseAND(F.bitwise_not(mask))
                    for k in range(3):
                        equal = equal & (F.get(words, place(x) + k) == F.get(words, place(y) + k))
                    return equal

                twice = F.filter(
                    p,
                    lambda x, i: F.coalesce(same(x, F.get(p, i - 1)), F.lit(False))
                    | F.coalesce(same(x, F.get(p, i + 1)), F.lit(False)),
                )
                starts = F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(mask)))
                return F.aggregate(
                    starts,
                    F.struct(lit_long(0).alias("n"), lit_long(0).alias("end")),
                    lambda a, s: F.struct(
                        (a["n"] + s + 3 - F.greatest(s, a["end"])).alias("n"), (s + 3).alias("end")
                    ),
                    lambda a: a["n"],
                )

            return let(F.sort_array(packed), with_sorted)

        return let(low, with_low)

    return F.when(n >= 4, let(F.length(F.bin(n.cast("bigint"))), with_bits)).otherwise(lit_long(0))


def featured(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """Words ``w`` and their hashes ``h`` beside what the rules count."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.select(F.col(id_col), *keep, text.alias("_t"))
        .withColumn("_w", words_of(F.col("_t")))
        .withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    )


def grams(h: Column, buckets: int) -> Column:
    """Buckets of all unigrams and bigrams of an array of word hashes."""
    b = F.lit(buckets)
    ones = F.transform(h, lambda x: F.pmod(x, b).cast("int"))
    twos = F.transform(h, lambda x, i: F.pmod(F.xxhash64(x, F.get(h, i + 1)), b).cast("int"))
    # the last word begins no bigram
    return F.concat(ones, F.slice(twos, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))))


def trusted_ids(labels: DataFrame, id_col: str, target_rows: int) -> DataFrame:
    good = labels.where((F.col("quality") == 1) & F.col(id_col).isNotNull()).select(id_col).distinct()
    return good.orderBy(F.xxhash64(id_col), id_col).limit(target_rows)


def log_ratios(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, buckets: int, target_rows: int
) -> DataFrame:
    """One row: ``ratios`` array<double>, by bucket."""
    # at most target_rows longs, whatever the size of the labels
    trusted = F.broadcast(trusted_ids(labels, id_col, target_rows).withColumn("_trusted", F.lit(1)))
    hashed = featured(docs.join(trusted, id_col, "left"), id_col, text_col, ["_trusted"])
    counts = (
        hashed.select("_trusted", F.explode(grams(F.col("_h"), buckets)).alias("b"))
        .groupBy("b")
        .agg(F.count("_trusted").alias("t"), F.count(F.lit(1)).alias("r"))
    )
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    zero = lambda c: F.coalesce(F.col(c), lit_long(0))
    dense = every.join(F.broadcast(counts), "b", "left").select("b", zero("t").alias("t"), zero("r").alias("r"))
    one = dense.agg(
        F.sort_array(F.collect_list(F.struct("b", "t", "r"))).alias("rows"),
        F.sum("t").alias("st"),
        F.sum("r").alias("sr"),
    )
    scaled = lambda t: t * (F.col("sr") / F.col("st"))
    return one.select(
        F.transform(
            "rows",
            lambda x: F.when(F.col("st") == 0, F.lit(0.0)).otherwise(
                F.log(scaled(x["t"]) + SMOOTHING) - F.log(x["r"] + SMOOTHING)
            ),
        ).alias("ratios")
    )


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    threshold: float = THRESHOLD,
    target_rows: int = TARGET_ROWS,
    carry: list[str] | None = None,
) -> DataFrame:
    """id, the columns named in ``carry``, rule counts, ``score``, ``base_failed`` and ``kept``."""
    carry = carry or []
    # ``buckets`` doubles, however large the corpus is; the cast of a literal is folded once
    row = log_ratios(docs, labels, id_col, text_col, buckets, target_rows).first()
    ratios = F.split(F.lit(",".join(map(repr, row["ratios"]))), ",").cast("array<double>")
    t, w, h = F.col("_t"), F.col("_w"), F.col("_h")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_grams = 2 * F.size(w) - 1
    total = F.aggregate(grams(h, buckets), F.lit(0.0), lambda a, b: a + F.get(ratios, b))
    cols = featured(docs, id_col, text_col, carry).select(
        id_col,
        *carry,
        F.size(w).cast("bigint").alias("n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeated_words(h, w).alias("n_repeat_words"),
        F.when(F.size(w) > 0, total / n_grams).otherwise(F.lit(0.0)).alias("score"),
        F.monotonically_increasing_id().alias("_at"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # _at keeps filters on the verdict above these columns: pushed below, they would compute the words anew in every loop
    verdict = ~F.col("base_failed") & (F.col("score") >= threshold) & (F.col("_at") >= 0)
    return cols.withColumn("base_failed", failed).withColumn("kept", verdict).drop("_at")


def op7_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge_quality(docs, labels).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.round("score", 9).alias("score"),
    )
