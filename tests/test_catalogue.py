"""Numbers and names of the columns of the feature sets, written once more by hand."""

from __future__ import annotations

import pytest

from weftline import features
from weftline.catalog import vocabulary_of
from weftline.sources.adapters import sources

# Numbers of features of the sets whose columns don't depend on the categories of the data.
COUNTS = {
    "ApplicationFeaturesOpenSolution": 28,
    "ApplicationFeaturesAntonova": 16,
    "AggregateFeatureApplicationOpenSolution": 256,
    "AggregateFeatureBureauOpenSolution": 57,
    "AggregateFeaturePreviousApplicationOpenSolution": 45,
    "AggregateFeaturePosCashOpenSolution": 15,
    "AggregateFeatureInstallmentsPaymentsOpenSolution": 30,
    "AggregateFeatureCreditCardBalanceOpenSolution": 70,
    "BureauFeaturesOpenSolution": 11,
    "PreviousApplicationFeaturesOpenSolution": 20,
    "PosCashFeaturesOpenSolution": 84,
    "InstallmentsPaymentsFeatures": 22,
    "InstallmentsPaymentsFeaturesOpenSolution": 358,
    "InstallmentsPaymentsFeaturesAntonova": 79,
    "CreditCardBalanceFeaturesOpenSolution": 9,
    "ApplicationFeaturesLDAOccupationTypeOrganizationType5": 5,
    "ApplicationFeaturesLDAOrganizationTypeOccupationType5": 5,
    "PredsLGBM1_1": 1,
}


@pytest.fixture(scope="module")
def tables(spark):
    return sources(spark, "/root/testdata/sf0.001")


def made(tables, name: str) -> list[str]:
    columns = features.build(name, tables, {"vocabulary": vocabulary_of(name)}).columns
    assert columns.count("SK_ID_CURR") == 1 and len(set(columns)) == len(columns)
    return [c for c in columns if c != "SK_ID_CURR"]


@pytest.mark.parametrize("name", sorted(COUNTS))
def test_number_of_features(tables, name):
    assert len(made(tables, name)) == COUNTS[name]


def test_names_of_recipes(tables):
    five = ("mean", "min", "max", "sum", "var")
    assert set(made(tables, "AggregateFeaturePosCashOpenSolution")) == {f"PosCash_SK_ID_CURR_{f}_{c}" for f in five for c in ("MONTHS_BALANCE", "SK_DPD", "SK_DPD_DEF")}
    payments = ("AMT_INSTALMENT", "AMT_PAYMENT", "DAYS_ENTRY_PAYMENT", "DAYS_INSTALMENT", "NUM_INSTALMENT_NUMBER", "NUM_INSTALMENT_VERSION")
    assert set(made(tables, "AggregateFeatureInstallmentsPaymentsOpenSolution")) == {f"InstallmentsPayments_SK_ID_CURR_{f}_{c}" for f in five for c in payments}
    of_clients = made(tables, "AggregateFeatureApplicationOpenSolution")
    assert "Application_NAME_EDUCATION_TYPE_CODE_GENDER_var_OWN_CAR_AGE" in of_clients and "Application_OCCUPATION_TYPE_mean_EXT_SOURCE_3" in of_clients
    topics = made(tables, "ApplicationFeaturesLDAOccupationTypeOrganizationType5")
    assert topics == [f"OCCUPATION_TYPE_LDA_ORGANIZATION_TYPE_dim{i}" for i in range(5)]


def test_names_of_pairs(tables):
    singles, pairs = made(tables, "ApplicationFeaturesSingleValueCounts"), made(tables, "ApplicationFeaturesPairValueCounts")
    n = len(singles)
    assert all(c.startswith("app_") and c.endswith("_value_count") for c in singles) and len(pairs) == n * (n - 1) // 2
    names = [c.removeprefix("app_").removesuffix("_value_count") for c in singles]
    assert pairs == [f"app_{a}_{b}_value_count" for i, a in enumerate(names) for b in names[i + 1 :]]


def test_names_of_two_levels(tables):
    names = set(made(tables, "BureauFeatures"))
    assert {"BURO_DAYS_CREDIT_VAR", "ACTIVE_AMT_CREDIT_SUM_SUM", "CLOSED_MONTHS_BALANCE_SIZE_SUM", "BURO_STATUS_C_MEAN_MEAN", "BURO_CREDIT_ACTIVE_nan_MEAN"} <= names
    numeric = {c for c in names if c.startswith("ACTIVE_")}
    assert len(numeric) == 20 and {c.replace("ACTIVE_", "CLOSED_") for c in numeric} <= names and {c.replace("ACTIVE_", "BURO_", 1) for c in numeric} <= names
