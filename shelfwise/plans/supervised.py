"""Train on one dataset, score it and others whose columns have other names."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from shelfwise.fixed_values import LEVELS
from shelfwise.operators.baseline import stratified_split
from shelfwise.operators.metrics import f1_by_level, long_levels
from shelfwise.operators.supervised import LevelModels


@dataclass(frozen=True)
class Dataset:
    """Where a dataset keeps its id, text and the label of each level."""

    rows: DataFrame
    row_id: str
    text: str
    labels: Sequence[str]

    def standard(self) -> DataFrame:
        """``(row_id, text, segment, family, class, brick)``."""
        return self.rows.select(self.row_id, self.text, *self.labels).toDF("row_id", "text", *LEVELS)


def train_and_score(
    train: Dataset, tests: dict[str, Dataset], fit: Callable[[DataFrame], LevelModels]
) -> tuple[LevelModels, DataFrame]:
    """Fit on four fifths of ``train``; weighted F1 per dataset and level.

    ``mean_f1`` is over the test sets; the validation part has its own figures only.

    ``fit`` takes the training rows in standard form, for instance
    ``lambda rows: train_svm(rows, "row_id", "text", LEVELS)``.
    """
    split = stratified_split(train.standard(), "row_id", LEVELS[0])
    models = fit(split.where("not is_test").drop("is_test"))
    scored = {"validation": split.where("is_test").drop("is_test")}
    scored.update({name: d.standard() for name, d in tests.items()})
    pairs = {level: (level, f"predicted_{level}") for level in LEVELS}
    frames = [
        long_levels(models.predict(rows, "row_id", "text", LEVELS), name, pairs)
        for name, rows in scored.items()
    ]
    return models, f1_by_level(frames, not_in_mean=("validation",))
