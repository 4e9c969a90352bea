"""End-to-end run over all use cases, by stage, with timing and scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import boosting, kernel_svm
from millrace.plans import (
    customer_segments,
    device_failures,
    payment_fraud,
    product_ratings,
    spam_reviews,
    store_forecast,
    trip_types,
)
from millrace.plans.runs import RunLog
from millrace.session import owned_intermediates
from millrace.sources.tables import replace_table

STAGES = ("preprocess", "train", "score", "serve")
Splits = Callable[[str], dict[str, DataFrame]]


@dataclass
class Run:
    """What the use cases share: input splits, output folder, log and settings.

    ``adjust_params`` selects the full parameter sets, as opposed to the fast ones.
    ``suffix`` keeps the outputs of parallel serving streams apart. Stages may run
    in different sessions: every model is stored under ``folder``.
    ``settings`` holds extra keyword arguments per use case for its training step.
    """

    spark: SparkSession
    splits: Splits
    folder: str
    stages: Sequence[str] = STAGES
    adjust_params: bool = True
    suffix: str = ""
    settings: dict[str, dict] = field(default_factory=dict)

    def __post_init__(self) -> None:
        unknown = set(self.stages) - set(STAGES)
        if unknown:
            raise ValueError(f"unknown stages: {', '.join(sorted(unknown))}")
        self.log = RunLog(self.spark, f"{self.folder}/log")

    def save(self, name: str, df: DataFrame) -> DataFrame:
        """Materialise one stage of a pipeline as a table, list it, and make it a view for SQL."""
        if "_serve_" in name:
            name += self.suffix
        saved = replace_table(df, f"{self.folder}/{name}")
        self.log.artefact(name, f"{self.folder}/{name}")
        saved.createOrReplaceTempView(name)
        return saved

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def note(self, usecase: int, metric: DataFrame) -> None:
        self.log.score(usecase, metric.first()[0])


def _uc01(run: Run) -> None:
    if "preprocess" in run.stages:
        with run.log.step("uc01", "preprocess (train)"):
            raw = customer_segments.features(run.splits("train"))
            raw = run.save("uc01_train_features", raw)
            scaler = run.save("uc01_scaler", customer_segments.scaling.minmax_fit(raw, customer_segments.SCALED))
            run.save("uc01_train_preprocessed", customer_segments.scaling.minmax_apply(raw, scaler, customer_segments.SCALED))
    if "train" in run.stages:
        with run.log.step("uc01", "train"):
            prepared = run.load("uc01_train_preprocessed")
            run.save("uc01_model", customer_segments.train(prepared))
    for split in ("score", "serve"):
        if split in run.stages:
            with run.log.step("uc01", split):
                scaled, _ = customer_segments.preprocess(run.splits(split), run.load("uc01_scaler"))
                scaled = run.save(f"uc01_{split}_preprocessed", scaled)
                if split == "score":
                    run.note(1, customer_segments.score(scaled, run.load("uc01_model")))
                else:
                    run.save("uc01_serve_results", customer_segments.serve(scaled, run.load("uc01_model")))


def _uc03(run: Run) -> None:
    if "preprocess" in run.stages:
        with run.log.step("uc03", "preprocess (train)"):
            run.save("uc03_train_preprocessed", store_forecast.weekly_sales(run.splits("train")))
    if "train" in run.stages:
        with run.log.step("uc03", "train"):
            run.save("uc03_model", store_forecast.train(run.load("uc03_train_preprocessed")))
    if "score" in run.stages:
        with run.log.step("uc03", "score"):
            predicted = run.save("uc03_score_predictions", store_forecast.predict(run.load("uc03_model")))
            observed = store_forecast.score_input(run.splits("score")["store_dept_labels"])
            run.save("uc03_score_results", store_forecast.compare(observed, predicted))
            run.note(3, store_forecast.score(observed, predicted))
    if "serve" in run.stages:
        with run.log.step("uc03", "serve"):
            asked = run.splits("serve")["store_dept"]
            run.save("uc03_serve_results", store_forecast.serve(asked, run.load("uc03_model")))
            run.save("uc03_serve_unmatched", store_forecast.unmatched(asked, run.load("uc03_model")))


def _uc04(run: Run) -> None:
    if "preprocess" in run.stages:
        with run.log.step("uc04", "preprocess (train)"):
            run.save("uc04_train_preprocessed", spam_reviews.preprocess(run.splits("train")["review"]))
    if "train" in run.stages:
        with run.log.step("uc04", "train"):
            model, priors = spam_reviews.train(run.load("uc04_train_preprocessed"))
            run.save("uc04_model", model)
            run.save("uc04_priors", priors)
    for split in ("score", "serve"):
        if split in run.stages:
            with run.log.step("uc04", split):
                prepared = run.save(f"uc04_{split}_preprocessed", spam_reviews.preprocess(run.splits(split)["review"]))
                made = spam_reviews.predict(prepared, run.load("uc04_model"), run.load("uc04_priors"))
                made = run.save("uc04_score_predictions" if split == "score" else "uc04_serve_results", made)
                if split == "score":
                    run.note(4, spam_reviews.score(made, run.splits("score")["review_labels"]))


def _uc06(run: Run) -> None:
    if "preprocess" in run.stages:
        with run.log.step("uc06", "preprocess (train)"):
            run.save("uc06_train_preprocessed", device_failures.preprocess(run.splits("train")["failures"], "train"))
    if "train" in run.stages:
        with run.log.step("uc06", "train"):
            prepared = run.load("uc06_train_preprocessed")
            model, scaler = device_failures.train(prepared, run.adjust_params, **run.settings.get("uc06", {}))
            kernel_svm.save(run.spark, model, f"{run.folder}/uc06_model")
            run.save("uc06_scaler", scaler)
    for split in ("score", "serve"):
        if split in run.stages:
            with run.log.step("uc06", split):
                prepared = device_failures.preprocess(run.splits(split)["failures"], split)
                model = kernel_svm.load(run.spark, f"{run.folder}/uc06_model")
                made = device_failures.predict(prepared, model, run.load("uc06_scaler"))
                made = run.save("uc06_score_predictions" if split == "score" else "uc06_serve_results", made)
                if split == "score":
                    run.note(6, device_failures.score(made, run.splits("score")["failures_labels"]))


def _uc07(run: Run) -> None:
    ratings = product_ratings.preprocess(run.splits("train")["productrating"])
    if "train" in run.stages:
        with run.log.step("uc07", "train"):
            users, items = product_ratings.train(ratings, run.adjust_params, **run.settings.get("uc07", {}))
            run.save("uc07_model_users", users)
            run.save("uc07_model_items", items)
    for split in ("score", "serve"):
        if split in run.stages:
            with run.log.step("uc07", split):
                factors = run.load("uc07_model_users"), run.load("uc07_model_items")
                pairs = product_ratings.preprocess(run.splits(split)["productrating"])
                made = product_ratings.predict(pairs, factors, ratings)
                made = run.save("uc07_score_predictions" if split == "score" else "uc07_serve_results", made)
                if split == "score":
                    run.note(7, product_ratings.score(made, run.splits("score")["productrating_labels"]))


def _uc08(run: Run) -> None:
    fit = run.settings.get("uc08", {})
    if "preprocess" in run.stages:
        with run.log.step("uc08", "preprocess (train)"):
            tables = run.splits("train")
            index = run.save("uc08_department_index", trip_types.department_index(tables["store_dept"]))
            run.save("uc08_train_preprocessed", trip_types.preprocess(tables, index, tables["store_dept"]))
    if "train" in run.stages:
        with run.log.step("uc08", "train"):
            model = trip_types.train(run.load("uc08_train_preprocessed"), **fit)
            boosting.save(run.spark, model, f"{run.folder}/uc08_model")
    for split in ("score", "serve"):
        if split in run.stages:
            with run.log.step("uc08", split):
                tables = run.splits(split)
                index = run.load("uc08_department_index")
                prepared = trip_types.preprocess(tables, index, tables["store_dept"])
                prepared = run.save(f"uc08_{split}_preprocessed", prepared)
                made = trip_types.predict(prepared, boosting.load(run.spark, f"{run.folder}/uc08_model"))
                made = run.save("uc08_score_predictions" if split == "score" else "uc08_serve_results", made)
                if split == "score":
                    run.note(8, trip_types.score(made, run.splits("score")["order_labels"]))


def _uc10(run: Run) -> None:
    if "preprocess" in run.stages:
        with run.log.step("uc10", "preprocess (train)"):
            run.save("uc10_train_preprocessed", payment_fraud.preprocess(run.splits("train")))
    if "train" in run.stages:
        with run.log.step("uc10", "train"):
            run.save("uc10_model", payment_fraud.train(run.load("uc10_train_preprocessed")))
    for split in ("score", "serve"):
        if split in run.stages:
            with run.log.step("uc10", split):
                prepared = run.save(f"uc10_{split}_preprocessed", payment_fraud.preprocess(run.splits(split)))
                made = payment_fraud.predict(prepared, run.load("uc10_model"))
                made = run.save("uc10_score_predictions" if split == "score" else "uc10_serve_results", made)
                if split == "score":
                    run.note(10, payment_fraud.score(made, run.splits("score")["financial_transactions_labels"]))


USE_CASES = {
    "uc01": _uc01, "uc03": _uc03, "uc04": _uc04, "uc06": _uc06, "uc07": _uc07, "uc08": _uc08, "uc10": _uc10,
}


def run_all(run: Run, use_cases: Sequence[str] = tuple(USE_CASES)) -> Run:
    """Run the selected use cases one after the other; their tables land in ``run.folder``."""
    for name in use_cases:
        with owned_intermediates(run.spark):
            USE_CASES[name](run)
    return run
