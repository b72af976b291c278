"""Benchmark decontamination with DataFrame functions only.

A window is 13 consecutive words of a benchmark item, or all words of a shorter one. A hash set of the windows' first
words, PREFIX_WORDS or as many as a shorter window has, picks candidate places while a document is scanned; only these
leave the row. A join on the words of the window verifies them, so what the set lets through in error is dropped.

The set is a bit for each hash, at most 2 ** MOST_BITS bits whatever the benchmark's size (about 10 MB), one set for each
number of first words, so that short items don't widen the scan for long ones. It is a literal of the plan, which Spark
broadcasts with the stage. The verifying join is left to Spark: broadcast below its threshold, else by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

WINDOW = 13
PREFIX_WORDS = 5
LEAST_BITS, MOST_BITS = 16, 26
ROOM = 64  # bits for each hash, as far as MOST_BITS goes
PLACES = "array<struct<i:int,m:int,win:array<string>>>"
WORD = 64  # bits of a long

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Array of the words of text, with A to Z in lower case; null and blank texts have none."""
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(lower, NOT_A_WORD), lambda w: w != "")


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(n, window, items): each distinct window, its number of words and the ids of its items."""
    items = benchmark.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).filter("size(w) > 0")
    n = F.least(F.size("w"), F.lit(window))
    placed = items.select("item", "w", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("i"))
    return placed.groupBy("n", F.slice("w", F.col("i"), F.col("n")).alias("window")).agg(F.collect_set("item").alias("items"))


def _slot(hashed: Column, bits: int) -> Column:
    return hashed.bitwiseAND(F.lit((1 << bits) - 1))


def hash_set(grams: DataFrame, words_: int) -> tuple[Column, int]:
    """A bit for the hash of the first `words_` words of each of the windows, as an array of longs, and the number of
    bits as a power of two. At most 2 ** MOST_BITS / 64 rows come to the driver.

    The longs are one text, split and cast, which the optimizer folds to a literal."""
    hashes = grams.select(F.xxhash64(F.slice("window", 1, words_)).alias("h")).distinct()
    bits = min(MOST_BITS, max(LEAST_BITS, (ROOM * hashes.count()).bit_length()))
    slot = _slot(F.col("h"), bits)
    rows = hashes.groupBy(F.call_function("shiftright", slot, F.lit(6)).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (slot % WORD).cast("int"))).alias("bits"))
    held = [0] * max(1, (1 << bits) // WORD)
    for r in rows.collect():
        held[r["at"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, held))), ",").cast("array<bigint>"), bits


def _among(set_: tuple[Column, int], hashed: Column) -> Column:
    """Whether the bit of a hash is set. The lambda binds its place, as the hash would otherwise be computed twice."""
    held, bits = set_
    bit = lambda s: F.getbit(held[F.call_function("shiftright", s, F.lit(6)).cast("int")], (s % WORD).cast("int")) == 1
    return F.exists(F.array(_slot(hashed, bits)), bit)


def _places(m: int, widest: int, set_: tuple[Column, int]) -> Column:
    """Places of the array w whose next m words are in the set, with the next `widest` words."""
    found = F.filter(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: _among(set_, F.xxhash64(F.slice("w", i, m))))
    told = F.transform(found, lambda i: F.struct(i.alias("i"), F.lit(m).alias("m"), F.slice("w", i, widest).alias("win")))
    return F.when(F.size("w") >= m, told).otherwise(F.expr(f"cast(array() as {PLACES})"))


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id_col, keep columns, n_words, spans, n_hit, items): a row for each document.

    spans: (first, last) word numbers from 1 of each occurrence, sorted; n_hit: words inside any of them; items:
    ids of the items with occurrences, as sorted strings. A null text has no words. Null and repeated ids stay
    rows of their own; items without words, with null ids or repeated ones count as far as they have windows and
    ids. An empty benchmark hits nothing."""
    grams = materialize(windows(benchmark, item_col, item_text_col, window), "windows")
    lengths = sorted(r.n for r in grams.select("n").distinct().collect())  # at most `window` numbers
    by_prefix: dict[int, list[int]] = {}
    for n in lengths:
        by_prefix.setdefault(min(PREFIX_WORDS, n), []).append(n)
    found = []
    for m, of in by_prefix.items():
        found.append(_places(m, max(of), hash_set(grams.filter(F.col("n").isin(of)), m)))
    places = F.concat(*found) if found else F.expr(f"cast(array() as {PLACES})")
    kept = list(dict.fromkeys([id_col, *keep]))
    scanned = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)], words(F.col(text_col)).alias("w"))
    scanned = materialize(
        scanned.select(F.monotonically_increasing_id().alias("row"), *[f"k{i}" for i in range(len(kept))], F.size("w").cast("bigint").alias("n_words"), places.alias("places")),
        "places",
    )
    place = scanned.filter(F.size("places") > 0).select("row", F.explode("places").alias("p")).select("row", "p.i", "p.m", "p.win")
    ends = F.lit(None).cast("array<int>")
    for m, of in by_prefix.items():
        ends = F.when(F.col("m") == m, F.array(*map(F.lit, of))).otherwise(ends)
    place = place.select("row", "i", "win", F.explode(ends).alias("n")).filter("size(win) >= n")
    place = place.select("row", "i", "n", F.slice("win", 1, F.col("n")).alias("window"))
    hits = place.join(grams, ["n", "window"]).select("row", F.struct(F.col("i").alias("first"), (F.col("i") + F.col("n") - 1).alias("last")).alias("span"), "items")
    per = hits.groupBy("row").agg(F.sort_array(F.collect_set("span")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
    n_hit = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["sum"] + F.greatest(F.lit(0), s["last"] - F.greatest(a["end"], s["first"] - 1))).alias("sum"),
            F.greatest(a["end"], s["last"]).alias("end"),
        ),
        lambda a: a["sum"].cast("bigint"),
    )
    none = F.expr("cast(array() as array<string>)")
    return (
        scanned.drop("places")
        .join(per, "row", "left")
        .select(
            *[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)],
            "n_words",
            "spans",
            F.coalesce(n_hit, F.lit(0).cast("bigint")).alias("n_hit"),
            F.coalesce(F.array_sort(F.array_distinct(F.transform("items", lambda x: x.cast("string")))), none).alias("items"),
        )
    )


def contaminated(n_hit: Column, n_words: Column, share: int = 20) -> Column:
    """At least one of `share` words lies inside a benchmark window."""
    return (n_hit > 0) & (n_hit * share >= n_words)


def _carried(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, options: dict) -> tuple[DataFrame, dict[str, str]]:
    """What find() says of each row of docs, with all its columns under names of their own, and those names."""
    own = {c: f"__doc{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*own.values())
    return find(plain, benchmark, own[id_col], own[text_col], keep=tuple(own.values()), **options), own


def remove_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the contaminated ones; all columns and other rows stay as they are.

    An id names a document: of rows with equal ids all go if one is contaminated. Rows without an id are judged
    one by one."""
    found = find(docs.filter(F.col(id_col).isNotNull()), benchmark, id_col, text_col, **options)
    bad = materialize(found.filter(contaminated(F.col("n_hit"), F.col("n_words"))).select(id_col).distinct(), "contaminated")
    kept = docs.join(bad, id_col, "left_anti").select(*docs.columns)
    nameless = docs.filter(F.col(id_col).isNull())
    if not nameless.limit(1).count():
        return kept
    judged, own = _carried(nameless, benchmark, id_col, text_col, options)
    clean = judged.filter(~contaminated(F.col("n_hit"), F.col("n_words"))).select(*[F.col(o).alias(c) for c, o in own.items()])
    return kept.filter(F.col(id_col).isNotNull()).union(clean)


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs whose texts have lost the words inside benchmark windows.

    A text that is hit is rebuilt from its other words, in lower case and joined by blanks; others stay as they
    are. A text that lies in windows wholly becomes empty. Every row stays, with all columns."""
    found, own = _carried(docs, benchmark, id_col, text_col, options)
    text = F.col(own[text_col])
    inside = lambda i: F.exists("spans", lambda s: (i + 1 >= s["first"]) & (i + 1 <= s["last"]))
    rest = F.array_join(F.filter(words(text), lambda w, i: ~inside(i)), " ")
    cleaned = found.withColumn(own[text_col], F.when(F.col("n_hit") > 0, rest).otherwise(text))
    return cleaned.select(*[F.col(o).alias(c) for c, o in own.items()])
