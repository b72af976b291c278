"""Count and target encodings, and feature sets cleaned by the column pruner."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.encode import categoricals, pair_counts, target_encode, target_encode_folds, value_counts
from ..plans.fusion import blocks_of
from ..selection import clean_blocks, clean_data
from ..sources.credit import CLIENT, TARGET
from . import build, feature
from .bureau import antonova_rows

CHILDREN = {
    "Bureau": "bureau",
    "PreviousApplication": "previous_application",
    "PosCash": "pos_cash",
    "CreditCardBalance": "credit_card",
}
#: Sets of very many columns, which are cleaned before a table is made of them.
IN_BLOCKS = {"Bureau": antonova_rows}


@feature("ApplicationFeaturesSingleValueCounts")
def single_counts(sources, conf) -> DataFrame:
    df = sources["application"]
    return value_counts(df, CLIENT, categoricals(df))


@feature("ApplicationFeaturesPairValueCounts")
def pairs(sources, conf) -> DataFrame:
    df = sources["application"]
    return pair_counts(df, CLIENT, categoricals(df))


@feature("ApplicationFeaturesLeakyTargetEncoding")
def leaky(sources, conf) -> DataFrame:
    df = sources["application"]
    return target_encode(df, CLIENT, categoricals(df), TARGET)


@feature("ApplicationFeaturesTargetEncoding")
def out_of_fold(sources, conf) -> DataFrame:
    df = sources["application"]
    return target_encode_folds(df, CLIENT, categoricals(df), TARGET, conf.get("n_splits", 5), conf.get("random_state", 47))


def _child_leaky(name: str, table: str) -> None:
    @feature(f"{name}FeaturesLeakyTargetEncoding")
    def make(sources, conf) -> DataFrame:
        child = sources[table]
        df = sources.base.join(child.drop(TARGET), CLIENT, "left")
        return target_encode(df, CLIENT, categoricals(child), TARGET)


def _cleaned(name: str) -> None:
    @feature(f"{name}FeaturesAntonovaCleaned")
    def make(sources, conf) -> DataFrame:
        """The set without its useless columns, with the target. Unless conf says otherwise, columns that models of the target
        don't need go, too."""
        from ..models import target_model, target_model_of_blocks

        by_model = conf.get("clean_by_model", True)
        if name in IN_BLOCKS:
            blocks = blocks_of(sources.base, TARGET, **IN_BLOCKS[name](sources, conf))
            return clean_blocks(sources.base, blocks, CLIENT, TARGET, target_model_of_blocks if by_model else None)
        df = sources.base.join(build(f"{name}FeaturesAntonova", sources, conf), CLIENT, "left")
        return clean_data(df, CLIENT, TARGET, target_model if by_model else None)


for _name, _table in CHILDREN.items():
    _child_leaky(_name, _table)
for _name in (*CHILDREN, "InstallmentsPayments"):
    _cleaned(_name)
