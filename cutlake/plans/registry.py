"""Registry of the runnable queries and the SQL their results are compared with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from cutlake.plans import derived

Plan = Callable[["Lib"], DataFrame]

# Added before rounding results to nine digits on both sides, so that products of
# short decimals do not end exactly on a half.
NUDGE = 1.2345e-10


class Lib:
    """The derived tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return derived.table(self.spark, self.sf_dir, name)

    def raw(self, name: str) -> DataFrame:
        return derived.parquet(self.spark, self.sf_dir, name)


@dataclass
class Registry:
    plans: dict[str, Plan] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, views: str = "", body: str = "", extra: str = ""):
        """Decorator: register a plan and, if given, its SQL over derived views."""

        def wrap(plan: Plan) -> Plan:
            if name in self.plans:
                raise ValueError(f"query {name} registered twice")
            self.plans[name] = plan
            if body:
                self.sql[name] = derived.with_views(views, body, extra) if (views or extra) else body
            return plan

        return wrap


REGISTRY = Registry()
