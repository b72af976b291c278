"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon is learned first: of the terms (words and beginnings of words) that at least `least_docs` toxic training
documents hold, a greedy cover keeps those that explain toxic documents no earlier term explains and that clean
ones hardly hold. It comes from labels alone, so it holds in any language. Documents are then scanned whole for
lexicon densities, the distance from lexicon hits to second-person words, capitals, punctuation and obfuscation.

Lexicon, trees and calibration are fitted on `max_train` labelled documents at most (those of least id hash), lexicon
and trees on four fifths of them, the calibration on the rest, which neither has seen. Everything else covers all
documents.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

MAX_TRAIN = 12_000
LEAST_DOCS = 4
PREFIXES = (4, 5, 6)
CLEAN_SHARE = 0.1
TREES, DEPTH = 20, 3
FIT_TASKS = 6  # of the fits, which read max_train rows at most
BY_MARGIN = 0.001  # share of the trees' own probability in a score: it orders documents within a step of the calibration

# Second-person pronouns of English, French, German and Spanish.
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "u", "ur", "tu", "toi", "te", "ton", "ta", "tes", "vous", "votre", "vos",
    "du", "dich", "dir", "dein", "deine", "deinen", "ihr", "euch", "euer", "ti", "tus", "usted", "ustedes", "vosotros",
)
# Characters that stand for letters in obfuscated words.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}

FEATURES = [
    "hits_per_word", "log_hits", "distinct_terms", "hidden_hits_per_word", "strongest", "second_person_density",
    "second_person_near", "capitals", "punctuation", "exclamations", "obfuscated", "digits", "log_words",
]

_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"(?<!\S)(?=\S*[^\W\d_])(?=\S*[\d@$!|€*._\-])[\w@$!|€*.\-]{3,}")
_STAND = str.maketrans(STAND_INS)
_KIND = np.zeros(256, np.uint8)  # 1 capital, 2 punctuation, 3 digit, 4 space, 5 letter
for _c in range(256):
    _KIND[_c] = 5 if _c >= 128 or 97 <= _c <= 122 else 1 if 65 <= _c <= 90 else 3 if 48 <= _c <= 57 else 4 if _c in (32, 9, 10, 11, 12, 13) else 2


def fold(id_col: str, of: int = 5) -> Column:
    """crc32 of the id as text, modulo `of`; 0, held out, is null-safe: a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % of, F.lit(0))


def unmask(word: str) -> str:
    """Letters of an obfuscated word: stand-ins become letters, what separates letters goes."""
    return "".join(_WORD.findall(word.translate(_STAND)))


def terms(text: str) -> set[str]:
    """Words (ending in a blank) and beginnings of words of a text, of its unmasked words too."""
    lower = text.lower()
    found = set(_WORD.findall(lower)) | {u for w in set(_MASKED.findall(lower)) if len(u := unmask(w)) >= 3}
    out = {w + " " for w in found if len(w) >= 3}
    for n in PREFIXES:
        out |= {w[:n] for w in found if len(w) >= n}
    return out


@dataclass
class Lexicon:
    """weights: log odds of each term; a term that ends in a blank is a whole word, others begin one."""

    weights: dict[str, float] = field(default_factory=dict)

    def scanner(self):
        import ahocorasick

        if not hasattr(self, "_scan"):
            self._scan = ahocorasick.Automaton()
            for t, w in self.weights.items():
                self._scan.add_word(t.strip(), (t.endswith(" "), len(t.strip()), w))
            for t in SECOND_PERSON:
                if t not in self._scan:
                    self._scan.add_word(t, (True, len(t), None))
            self._scan.make_automaton()
        return self._scan

    def __getstate__(self) -> dict:
        return {"weights": self.weights}

    def hits(self, lower: str) -> tuple[list[tuple[int, str, float]], list[int]]:
        """(place, term, weight) of each lexicon hit and the places of second-person words."""
        found, second, last = [], [], len(lower) - 1
        for end, (whole, n, weight) in self.scanner().iter(lower):
            start = end - n + 1
            if start and lower[start - 1].isalpha() or whole and end < last and lower[end + 1].isalpha():
                continue
            if weight is None:
                second.append(start)
            else:
                found.append((start, lower[start : end + 1], weight))
        return found, second

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        kinds = _KIND[raw]
        many = np.bincount(kinds, minlength=6)
        inner = kinds[1:-1]
        letter = (kinds == 1) | (kinds == 5)
        masked = int(np.count_nonzero(letter[:-2] & letter[2:] & ((inner == 2) | (inner == 3)))) if len(kinds) > 2 else 0
        space = kinds == 4
        n_words = int(np.count_nonzero(space[:-1] & ~space[1:])) + int(len(space) > 0 and not space[0])
        lower = text.lower()
        found, second = self.hits(lower)
        hidden: list = []
        if masked and self.weights:
            unmasked = " ".join(u for w in _MASKED.findall(lower) if len(u := unmask(w)) >= 3)
            hidden = self.hits(unmasked)[0] if unmasked else []
        near = 0.0
        if found and second:
            at, places = np.array([f[0] for f in found]), np.array(second)
            k = np.searchsorted(places, at)
            gaps = np.minimum(np.abs(at - places[np.maximum(k - 1, 0)]), np.abs(places[np.minimum(k, len(places) - 1)] - at))
            near = 1.0 / (1.0 + float(gaps.min()) / 10.0)
        both = found + hidden
        words_, chars = max(1, n_words), max(1, len(raw))
        letters = max(1, int(many[1] + many[5]))
        return [
            len(found) / words_,
            float(np.log1p(len(both))),
            float(len({t for _, t, _ in both})),
            len(hidden) / words_,
            max((w for _, _, w in both), default=0.0),
            len(second) / words_,
            near,
            int(many[1]) / letters,
            int(many[2]) / chars,
            text.count("!") / words_,
            masked / words_,
            int(many[3]) / chars,
            float(np.log1p(n_words)),
        ]


def training_ids(labels: DataFrame, id_col: str, label_col: str, max_train: int) -> DataFrame:
    """(id, label) of the at most max_train labelled documents that may be learned from. Labels other than 0 and 1
    are ignored; of repeated labels the larger counts."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(id_col) != 0))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("label"))
    return known.orderBy(F.xxhash64("id"), "id").limit(max_train)


def cover(candidates: list[tuple[str, int, int]], documents: list[set[int]], least_docs: int) -> list[int]:
    """Numbers of the candidates (term, toxic, clean) that a greedy cover takes: each next one holds most documents that
    no earlier one holds, least_docs at least; of equal ones that with fewer clean documents, then the longer term."""
    left = set().union(*documents) if documents else set()
    heap = [(-len(d), clean, -len(t), i) for i, ((t, _, clean), d) in enumerate(zip(candidates, documents))]
    heapq.heapify(heap)
    chosen = []
    while heap:
        gain, clean, length, i = heapq.heappop(heap)
        now = len(documents[i] & left)
        if now < least_docs:
            continue
        if -gain != now:  # gains only shrink
            heapq.heappush(heap, (-now, clean, length, i))
            continue
        chosen.append(i)
        left -= documents[i]
    return chosen


def learn_lexicon(train: DataFrame, least_docs: int = LEAST_DOCS) -> Lexicon:
    """train: text, label. Documents with equal texts count once. What comes to the driver is bounded by max_train."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[int(label)].update(terms(text))
        # a clean term that no toxic document of this task holds may still be one of another task
        keys = list(set(seen[0]) | set(seen[1]))
        yield pa.RecordBatch.from_pydict({"term": pa.array(keys, pa.string()), "toxic": [seen[1][k] for k in keys], "clean": [seen[0][k] for k in keys]})

    distinct = train.filter("text is not null and text != ''").groupBy("text").agg(F.max("label").alias("label"))
    totals = {int(r.label): r.n for r in distinct.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon()
    counted = distinct.mapInArrow(count, "term string, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rate = (F.col("toxic") / n_toxic) / ((F.col("clean") + 0.5) / n_clean)
    kept = counted.filter((F.col("toxic") >= least_docs) & (rate >= 1 / CLEAN_SHARE))
    candidates = sorted((r.term, r.toxic, r.clean) for r in kept.collect())
    index = {t: i for i, (t, _, _) in enumerate(candidates)}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(index[t] for t in terms(x) if t in index) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["held"])

    toxic = [r.held for r in distinct.filter("label = 1").select("text").mapInArrow(held, "held array<int>").collect()]
    documents: list[set[int]] = [set() for _ in candidates]
    for d, terms_held in enumerate(toxic):
        for t in terms_held:
            documents[t].add(d)
    weight = lambda n1, n0: float(np.log((n1 + 0.5) / (n_toxic + 1)) - np.log((n0 + 0.5) / (n_clean + 1)))
    weights = {candidates[i][0]: weight(*candidates[i][1:]) for i in cover(candidates, documents, least_docs)}
    # terms as good as a chosen one that cover the same documents: other words of the same writers
    begun = tuple(k for k in weights if not k.endswith(" "))
    for t, n1, n0 in candidates:
        if n0 == 0 and n1 >= max(5 * least_docs, 0.02 * n_toxic) and not t.startswith(begun):
            weights.setdefault(t, weight(n1, n0))
    return Lexicon(weights)


def featurize(docs: DataFrame, lexicon: Lexicon, text_col: str, keep: list[Column]) -> DataFrame:
    """keep, then FEATURES, for every row; whole texts, null as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([lexicon.features(t) for t in batch.column(0).to_pylist()], dtype=np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(np.ascontiguousarray(made[:, i])) for i in range(len(FEATURES)))], names=[*batch.schema.names[1:], *FEATURES])

    rows = docs.select(F.col(text_col), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:])
    return rows.mapInArrow(run, ", ".join(x for x in (fields, *(f"{f} double" for f in FEATURES)) if x))


class Model:
    """lexicon, trees and calibration; trees is None where only one label was known, then rate is every score."""

    def __init__(self, lexicon: Lexicon, trees, calibration, rate: float) -> None:
        self.lexicon, self.trees, self.calibration, self.rate = lexicon, trees, calibration, rate

    def score(self, docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
        """keep and score, for every row."""
        names = docs.select(*keep).columns
        if self.trees is None:
            return docs.select(*keep, F.lit(self.rate).alias("score"))
        featured = featurize(docs, self.lexicon, text_col, keep)
        raw = self.trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="tox_features").transform(featured))
        margin = raw.select(*names, vector_to_array("tox_probability")[1].alias("tox_margin"))
        assembled = VectorAssembler(inputCols=["tox_margin"], outputCol="tox_margins").transform(margin)
        known = self.calibration.transform(assembled)
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("tox_calibrated") * (1 - BY_MARGIN) + F.col("tox_margin") * BY_MARGIN))
        return known.select(*names, score.alias("score"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """Learn from labelled rows whose crc32(id) mod 5 isn't 0. Without both labels the model scores their rate
    (0 without any)."""
    ids = training_ids(labels, id_col, label_col, max_train)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    part = (F.xxhash64("id", F.lit("calibrate")) % 5 == 0).alias("held")
    train = materialize(texts.join(F.broadcast(ids), "id").select("text", "label", part), "tox-train")
    lexicon = learn_lexicon(train.filter("not held"))
    featured = materialize(featurize(train, lexicon, "text", [F.col("label"), F.col("held")]).coalesce(FIT_TASKS), "tox-features")
    seen = {(r.label, r.held): r.n for r in featured.groupBy("label", "held").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(seen.values())
    rate = sum(n for (label, _), n in seen.items() if label == 1) / total if total else 0.0
    if not seen.get((1.0, False)) or not seen.get((0.0, False)):
        return Model(lexicon, None, None, rate)
    data = VectorAssembler(inputCols=FEATURES, outputCol="tox_features").transform(featured)
    trees = GBTClassifier(
        featuresCol="tox_features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxMemoryInMB=64,
    ).fit(data.filter("not held").select("label", "tox_features"))
    held = data.filter("held") if seen.get((1.0, True)) and seen.get((0.0, True)) else data
    trees = trees.setPredictionCol("tox_class").setProbabilityCol("tox_probability").setRawPredictionCol("tox_raw")
    margins = trees.transform(held.select("label", "tox_features")).select("label", vector_to_array("tox_probability")[1].alias("tox_margin"))
    calibration = IsotonicRegression(featuresCol="tox_margins", labelCol="label", predictionCol="tox_calibrated").fit(
        VectorAssembler(inputCols=["tox_margin"], outputCol="tox_margins").transform(margins)
    )
    return Model(lexicon, trees, calibration, rate)


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: tuple[str, ...] = (), max_train: int = MAX_TRAIN
) -> DataFrame:
    """(id_col, keep columns, held_out, score, predicted) for every row of docs.

    Null and empty texts are scored from empty features. A null id counts as held out. Repeated ids are scored row
    by row. Labels without a document and documents without a label don't matter."""
    model = fit(docs, labels, id_col, text_col, label_col, max_train)
    names = list(dict.fromkeys([id_col, *keep]))
    scored = model.score(docs, text_col, [F.col(c).alias(f"tox_k{i}") for i, c in enumerate(names)])
    out = scored.select(*[F.col(f"tox_k{i}").alias(c) for i, c in enumerate(names)], "score")
    return out.select(*names, (fold(id_col) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs that aren't predicted toxic, with all their columns, whatever these are called."""
    own = {c: f"tox_doc{i}" for i, c in enumerate(docs.columns)}
    known = labels.withColumnRenamed(id_col, own[id_col])
    judged = classify(docs.toDF(*own.values()), known, own[id_col], own[text_col], keep=tuple(own.values()), **options)
    return judged.filter("predicted = 0").select(*[F.col(o).alias(c) for c, o in own.items()])
