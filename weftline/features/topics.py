"""Topic mixtures of categories: a category as the document of the categories it occurs with."""

from __future__ import annotations

from pyspark.ml.clustering import LDA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..nulls import col
from ..operators.encode import vocabulary
from ..operators.joins import lookup
from ..sources.credit import CLIENT
from . import feature


def category_vectors(df: DataFrame, key: str, by: str, words: str, topics: int = 5, seed: int = 71, iterations: int = 20) -> DataFrame:
    """(key, by_LDA_words_dim0 ...): the topic mixture of the row's `by` category, learned from the `words` categories
    of its rows. A row without the category has none.

    Documents are counts of (by, words) pairs, so nothing collects a category's rows; more distinct words than a vocabulary may
    have are an error."""
    pairs = df.filter(col(by).isNotNull() & col(words).isNotNull()).groupBy(col(by).alias("__by"), col(words).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    vocab = vocabulary(pairs, ["w"])["w"]
    if not vocab:
        return df.select(col(key), *[F.lit(None).cast("double").alias(f"{by}_LDA_{words}_dim{i}") for i in range(topics)])
    place = F.array_position(F.array(*map(F.lit, vocab)), F.col("w")) - 1
    # a row of counts for each category, of its words only; the others are 0 in its vector
    held = pairs.groupBy("__by").agg(F.map_from_entries(F.collect_list(F.struct(place, F.col("n").cast("double")))).alias("held"))
    every = F.transform(F.sequence(F.lit(0), F.lit(len(vocab) - 1)), lambda i: F.coalesce(F.try_element_at("held", i.cast("bigint")), F.lit(0.0)))
    counted = held.select("__by", array_to_vector(every).alias("features"))
    model = LDA(k=topics, optimizer="online", seed=seed, maxIter=iterations).fit(counted)
    mixed = model.transform(counted).select("__by", vector_to_array("topicDistribution").alias("__t"))
    return lookup(df.select(col(key), col(by)), mixed, {by: "__by"}, {f"{by}_LDA_{words}_dim{i}": F.col("__t")[i] for i in range(topics)}).drop(by)


@feature("ApplicationFeaturesLDAOccupationTypeOrganizationType5")
def occupations(sources, conf) -> DataFrame:
    return category_vectors(sources["application"], CLIENT, "OCCUPATION_TYPE", "ORGANIZATION_TYPE")


@feature("ApplicationFeaturesLDAOrganizationTypeOccupationType5")
def organizations(sources, conf) -> DataFrame:
    return category_vectors(sources["application"], CLIENT, "ORGANIZATION_TYPE", "OCCUPATION_TYPE")
