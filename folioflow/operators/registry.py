"""Model registry (D13, UDF-6, UDF-7) and the lookups on it (JN-1, JN-2, TOP-1)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.recognize import Recognizer
from folioflow.schemas import UNKNOWN_MODEL_ERROR

SCHEMA = "ordinal int, name string, loaded boolean, failure_reason string"


class Registry:
    """Loads each wished recognizer; one that fails doesn't stop the others."""

    def __init__(self, factories: Mapping[str, Callable[[], Recognizer]], enabled: Sequence[str]):
        self.factories, self.enabled = dict(factories), tuple(enabled)
        self.loaded: dict[str, Recognizer] = {}
        self.failed: dict[str, str] = {}

    def initialize(self, names: Sequence[str] | None = None) -> dict[str, int]:
        """AGG-8: returns how many were requested, loaded and failed."""
        wished = self.enabled if names is None else tuple(names)
        self.loaded, self.failed = {}, {}
        for name in wished:
            make = self.factories.get(name)
            if make is None:
                self.failed[name] = UNKNOWN_MODEL_ERROR
                continue
            try:
                model = make()
                model.load()
            except Exception as e:
                self.failed[name] = str(e)
            else:
                self.loaded[name] = model
        return {"requested": len(wished), "loaded": len(self.loaded), "failed": len(self.failed)}

    def get(self, name: str) -> Recognizer | None:
        return self.loaded.get(name)

    def all(self) -> dict[str, Recognizer]:
        return self.loaded

    def active(self) -> Recognizer | None:
        return next((self.loaded[n] for n in self.enabled if n in self.loaded), None)

    def active_name(self) -> str | None:
        model = self.active()
        return None if model is None else model.name

    def failure(self) -> str | None:
        return next((f"{n}: {self.failed[n]}" for n in self.enabled if self.failed.get(n)), None)

    def shutdown(self) -> None:
        for model in self.loaded.values():
            try:
                model.unload()
            except Exception:  # the others still have to be unloaded
                continue

    def table(self, spark: SparkSession) -> DataFrame:
        order = {n: i for i, n in reversed(list(enumerate(self.enabled)))}
        names = dict.fromkeys([*self.enabled, *self.loaded, *self.failed])
        return spark.createDataFrame([(order.get(n), n, n in self.loaded, self.failed.get(n)) for n in names], SCHEMA)


def load_summary(registry: DataFrame) -> DataFrame:
    """AGG-8 on the table: how many models were requested, loaded and failed. One may be loaded now and have a reason
    from before; it counts as loaded."""
    asked = registry.filter("ordinal IS NOT NULL")
    n = lambda c: F.count(F.when(c, 1)).alias
    return asked.agg(F.count("*").alias("requested"), n(F.col("loaded"))("loaded"), n(~F.col("loaded"))("failed"))


def active_model(registry: DataFrame) -> DataFrame:
    """JN-1, TOP-1: first loaded model in configured order; one row, NULL when there is none."""
    hit = F.col("loaded") & F.col("ordinal").isNotNull()
    return registry.agg(F.min_by("name", F.when(hit, F.col("ordinal"))).alias("active_model"))


def active_failure(registry: DataFrame) -> DataFrame:
    """JN-2: the first reason that isn't empty, as 'name: reason'."""
    hit = (F.coalesce("failure_reason", F.lit("")) != "") & F.col("ordinal").isNotNull()
    return registry.agg(F.min_by(F.concat("name", F.lit(": "), "failure_reason"), F.when(hit, F.col("ordinal"))).alias("failure"))
