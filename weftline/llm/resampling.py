"""Importance resampling towards a target: documents are drawn by how much their words belong to the target's texts.

Features are runs of consecutive words, hashed to buckets. Identical texts are grouped by their full text first, so features,
bucket counts and weights are made once for each different text and counted as often as the text occurs. Weights are joined
back to the rows before each row gets its own noise (a Gumbel variate from its id), and the rows of highest score are drawn.

Counts of buckets have as many rows as there are buckets, a parameter, so they are the only thing that the plan carries
to all tasks. A text that very many rows share is one row from the grouping on; the join back to its rows goes through plain
exchanges, which adaptive execution splits where one text has many rows. Ranks come from ranges of scores, not from one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import words
from .order import numbered, whole_numbers
from .shared import discard, materialize

LONGEST = 1  # words of a feature at most
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
SPAN = 1 << 32


def features(w: Column, longest: int = LONGEST) -> Column:
    """All runs of 1 to `longest` consecutive words of the array w, joined by one blank."""

    def runs(n: int) -> Column:
        joined = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, joined).otherwise(F.expr("cast(array() as array<string>)"))

    return F.concat(w, *map(runs, range(2, longest + 1))) if longest > 1 else w


def buckets_of(text: Column, longest: int = LONGEST, buckets: int = BUCKETS) -> Column:
    """The bucket of each feature of a text."""
    return F.transform(features(words(text), longest), lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int"))


def text_key(text: Column) -> Column:
    """A key of 16 bytes for a text; a null text is an empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def different_texts(docs: DataFrame, text_col: str, longest: int, buckets: int) -> DataFrame:
    """(key, n, b): each different text's key, the number of its rows and the buckets of its features."""
    texts = docs.groupBy(F.coalesce(F.col(text_col), F.lit("")).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    return texts.select(text_key(F.col("text")).alias("key"), "n", buckets_of(F.col("text"), longest, buckets).alias("b"))


def bucket_counts(texts: DataFrame, buckets: int) -> list[int]:
    """How many features fall into each bucket; `buckets` numbers, whatever the texts."""
    counts = texts.select("n", F.explode("b").alias("b")).groupBy("b").agg(F.sum("n").alias("n"))
    held = [0] * buckets
    for r in counts.collect():
        held[r["b"]] = r["n"]
    return held


def gains(source: list[int], target: list[int]) -> list[int]:
    """Each bucket's gain: 1000 times the log of its share in the target over that in the source, each with one more
    feature in every bucket, rounded down."""
    all_s, all_t = float(sum(source) + len(source)), float(sum(target) + len(target))
    return [math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t))) for s, t in zip(source, target)]


def noise(id_: Column, seed: int) -> Column:
    """1000 times a Gumbel variate that the seed and the id determine, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / float(SPAN)))).cast("bigint")


def weights(
    docs: DataFrame, target: DataFrame, text_col: str = "text", target_text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS
) -> DataFrame:
    """(key, n, n_features, weight) of each different text of docs: n rows have it, weight is the mean gain of its features,
    rounded down, 0 without features."""
    texts = materialize(different_texts(docs, text_col, longest, buckets), "texts")
    aim = different_texts(target, target_text_col, longest, buckets)
    gain = whole_numbers(gains(bucket_counts(texts, buckets), bucket_counts(aim, buckets)), "int")
    total = F.aggregate("b", F.lit(0).cast("bigint"), lambda sum_, b: sum_ + gain[b])
    weighed = texts.select("key", "n", F.size("b").cast("bigint").alias("n_features"), total.alias("total"))
    mean = F.expr("if(n_features = 0, 0L, (total - pmod(total, n_features)) div n_features)")
    out = materialize(weighed.select("key", "n", "n_features", mean.alias("weight")), "weights")
    discard(texts)
    return out


def scores(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", seed: int = SEED, longest: int = LONGEST, buckets: int = BUCKETS
) -> DataFrame:
    """(row, id, key, n_features, weight, score) of each row of docs, as a table; row numbers the rows, key is the text's.

    A null text counts as empty: no features, weight 0. Rows with equal ids have equal noise; a row without an id has none
    and no score. No rows give no rows; an empty target prefers features that are rare in docs."""
    known = weights(docs, target, text_col, target_text_col, longest, buckets)
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"))
    joined = rows.join(known, "key").select(F.monotonically_increasing_id().alias("row"), "id", "key", "n_features", "weight")
    out = materialize(joined.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scores")
    discard(known)
    return out


def ranked(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """scored with rank: 1, 2, ... of the drawn rows, null of others.

    Of the rows that have an id and `least_words` features at least, the `percent` of highest score are drawn, ties to the
    smaller id and then in the order of rows."""
    able = scored.filter((F.col("n_features") >= least_words) & F.col("id").isNotNull())
    counts = {r["score"]: r["count"] for r in able.groupBy("score").count().collect()}  # scores are whole numbers of a fixed range
    draw = percent * sum(counts.values()) // 100
    bar, above = None, 0
    for score in sorted(counts, reverse=True):
        if above >= draw:
            break
        bar, above = score, above + counts[score]
    null = F.lit(None).cast("bigint")
    if bar is None:
        return scored.withColumn("rank", null)
    near = (F.col("n_features") >= least_words) & F.col("id").isNotNull() & (F.col("score") >= bar)
    order = [F.desc("score"), F.asc("id"), F.asc("row")]
    placed = numbered(scored.filter(near), order, "at", "drawn")
    rank = F.when(F.col("at") < draw, F.col("at") + 1).alias("rank")
    return placed.select(*scored.columns, rank).unionByName(scored.filter(~F.coalesce(near, F.lit(False))).withColumn("rank", null))


def importance(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", least_words: int = LEAST_WORDS, percent: int = PERCENT, **options) -> DataFrame:
    """(id_col, n_features, weight, score, rank), a row for each row of docs; see :func:`scores` and :func:`ranked`."""
    found = ranked(scores(docs, target, id_col, **options), least_words, percent)
    return found.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn rows of docs with all their columns. Rows are named by id and text: of rows that share both all are kept
    if one is drawn."""
    least_words, percent = options.pop("least_words", LEAST_WORDS), options.pop("percent", PERCENT)
    found = ranked(scores(docs, target, id_col, text_col, **options), least_words, percent)
    drawn = found.filter("rank is not null").select(F.col("id").alias("__drawn_id"), F.col("key").alias("__drawn_key")).distinct()
    same = (docs[id_col] == F.col("__drawn_id")) & (text_key(docs[text_col]) == F.col("__drawn_key"))
    return docs.join(drawn, same, "left_semi")
