"""Quality rules: text statistics, then a hashed n-gram log-likelihood ratio. DataFrame functions only.

Words and word pairs hash into a fixed number of buckets. One multinomial is counted over the trusted documents, one
over the raw corpus; a document's score is the mean log ratio of its n-grams, in whole millionths, so sums are exact
and every rerun gives the same verdict. The table of ratios has ``BUCKETS`` rows whatever the corpus holds: that bound
is why it may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import WORD, cut

#: Rows of the ratio table; the most trusted documents that the target is fitted on; raw n-grams by which each bucket's ratio is drawn to 1.
BUCKETS, MOST_TRUSTED, PSEUDO = 1 << 16, 20_000, 30.0
#: A document is kept from this mean log ratio (millionths) on.
KEEP_FROM = -100_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def grams_of(hashes: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all words, then of all pairs of neighbours; repeats included."""
    n = F.greatest(F.size(hashes) - 1, F.lit(0))
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    two = F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 2, n), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int"))
    return F.concat(one, two)


def trusted(labels: DataFrame, most: int = MOST_TRUSTED) -> DataFrame:
    """Ids of good, non-toxic documents: at most ``most``, those with the smallest hashes."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, llr) for every bucket seen: log ratio of trusted to raw frequency in millionths."""
    flag = trusted(labels).withColumn("good", F.lit(1))
    grams = docs.join(F.broadcast(flag), "doc_id", "left").select(F.coalesce("good", F.lit(0)).alias("good"), hashes_of(words_of(F.col("text"))).alias("hashes")).select("good", F.explode(grams_of(F.col("hashes"), buckets)).alias("bucket"))
    counts = cut(grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("r"), F.sum("good").alias("t")))
    sums = counts.agg(F.coalesce(F.sum("r"), F.lit(0)).alias("r"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    share = sums["t"] / sums["r"] if sums["t"] else 1.0
    llr = F.log((F.col("t") + PSEUDO * share) / ((F.col("r") + PSEUDO) * share)) if sums["t"] else F.lit(0.0)
    return counts.select("bucket", F.round(llr * 1_000_000).cast("long").alias("llr"))


def statistics(text: Column, words: Column) -> dict[str, Column]:
    """Per-document counts that need only the text and its words."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    return {
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words to a frame with ``hashes`` of the words: words inside 3-word windows that the text holds
    twice or more.

    The windows of one text, by their 64-bit hashes, are sorted within its row; equal neighbours mark their positions.
    """
    h = F.col("hashes")
    m = F.greatest(F.size(h) - 2, F.lit(0))
    pairs = F.zip_with(F.slice(h, 1, m), F.slice(h, 2, m), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("windows", F.zip_with(pairs, F.slice(h, 3, m), lambda a, b: F.xxhash64(a, b)))
    some = F.size(F.array_distinct("windows")) < F.size("windows")  # else nothing repeats, and nothing need be sorted
    df = df.withColumn("sorted", F.when(some, F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("t"), i.alias("i"))))))
    s = F.col("sorted")
    # the sorted array is read more than once below, so that the optimizer keeps it as a column of its own
    twice = F.filter(s, lambda x, j: (x["t"] == F.get(s, j - 1)["t"]) | (x["t"] == F.get(s, j + 1)["t"]))
    found = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return df.withColumn("n_repeat_words", F.when(s.isNull(), 0).otherwise(found).cast("long")).drop("windows", "sorted")


def as_array(table: DataFrame, buckets: int) -> Column:
    """The ratios as one constant array of ``buckets`` longs, 0 where a bucket was not seen."""
    values = [0] * buckets
    for r in table.collect():  # at most ``buckets`` rows
        values[r["bucket"]] = r["llr"]
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")  # folded to a constant by the optimizer


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr_mean", "base_failed", "kept")


def judge(docs: DataFrame, labels: DataFrame, keep_from: int = KEEP_FROM, buckets: int = BUCKETS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, the statistics, llr_mean (millionths), base_failed, kept; or ``carry`` and kept.

    Null and empty texts have no words and fail the base rules. Repeated rows are judged alike, each on its own
    row; a null id is a document like any other, never trusted. Without labels every ratio is near 0 and nothing
    is rejected by it. An empty table gives an empty result. Other columns of ``docs`` are not read; in ``carry`` any
    name may stand.
    """
    table = as_array(ratios(docs.select("doc_id", "text"), labels, buckets), buckets)
    rows = docs.select(F.struct(*(carry or ("doc_id",))).alias("own"), F.col("text").alias("text"), words_of(F.col("text")).alias("words"))
    stats = statistics(F.col("text"), F.col("words"))
    base = rows.select("own", hashes_of(F.col("words")).alias("hashes"), *[c.alias(k) for k, c in stats.items()])
    base = repeat_words(base).withColumn("n_words", F.size("hashes").cast("long")).withColumn("grams", grams_of(F.col("hashes"), buckets))
    total = F.aggregate("grams", F.lit(0).cast("long"), lambda acc, b: acc + F.get(table, b))
    mean = F.when(F.size("grams") > 0, F.floor(total / F.size("grams"))).cast("long")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = base.select("own", "n_words", *stats, "n_repeat_words", mean.alias("llr_mean"), failed.alias("base_failed"))
    judged = judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("llr_mean") >= keep_from, F.lit(False)))
    # one row in, one row out: a generator keeps later filters from being pushed into, and inlining, the sorts above
    held = ("own", "kept") if carry else ("own", *FIGURES)
    return judged.select(F.inline(F.array(F.struct(*held))))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, columns unchanged; texts are not shuffled."""
    return judge(docs, labels, carry=tuple(docs.columns)).where("kept").select("own.*")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).select("own.doc_id", *FIGURES)
