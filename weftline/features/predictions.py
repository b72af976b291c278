"""Earlier predictions as feature sets, for stacking."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.runs import side_by_side
from . import feature

# Names of feature sets and of the runs that they hold.
PINNED = {
    "PredsLGBM1_1": "08191504_lgbm_1-1_0.793821",
    "PredsLogReg0": "08192245_logreg_0_0.777166",
    "PredsLGBM3_1": "08210425_lgbm_3-1_0.794708",
    "PredsLGBM3_1_0": "08211432_lgbm_3-1-0_0.795889",
}
# Failed runs.
FAILED = ("08192001_logreg_0_0.541404", "08201837_lgbm_dev_0.534762")


def _pinned(name: str, run: str) -> None:
    @feature(name)
    def make(sources, conf) -> DataFrame:
        return sources.runs[run]


for _name, _run in PINNED.items():
    _pinned(_name, _run)


@feature("PredsAll")
def every_run(sources, conf) -> DataFrame:
    """A column for each run there is, but for the failed ones."""
    names = [n for n in sources.runs.names() if n not in FAILED]
    if not names:
        raise ValueError("there are no runs")
    return side_by_side([sources.runs[n] for n in names])
