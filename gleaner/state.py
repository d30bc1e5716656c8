"""A resumable run's state under one folder: results, crawled keys, completed plans, leads, and its settings.

The state is a set of versioned tables (``versions``): what belongs together, such as a plan's rows and the mark that it is
completed, is committed together, so a state is never of two ages, and a version that was cut short is passed over.
A run that resumes with other settings raises.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.versions import Versions

PARTS = ("search_results", "crawled", "completed_plans", "completed_locations", "leads")
SETTINGS = ("category", "location", "countries", "limit", "max_leads", "dedupe_by")


def every(results: int) -> int:
    """Sites after which a run of so many results saves its state."""
    return 10 if results < 1000 else 150 if results < 5000 else 500


class RunState:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, path)

    def begin(self, **settings: object) -> bool:
        """Starts a run, or goes on with one of the same settings: whether it goes on."""
        own = json.loads(json.dumps({k: settings.get(k) for k in SETTINGS}))
        held = self.versions.current()["facts"].get("settings")
        if held is None:
            self.versions.commit({}, {"settings": own})
            return False
        wrong = [k for k in SETTINGS if held.get(k) != own[k]]
        if wrong:
            raise ValueError(f"the state at {self.path} is of another run: {', '.join(wrong)} differ")
        return True

    def append(self, part: str, rows: DataFrame) -> None:
        self.append_all({part: rows})

    def append_all(self, parts: dict[str, DataFrame], name: str | None = None) -> bool:
        """Adds rows to several parts at once; a commit of a name that the state holds adds nothing."""
        for part in parts:
            if part not in PARTS:
                raise ValueError(part)
        return self.versions.commit(parts, name=name)

    def read(self, part: str, schema: str) -> DataFrame:
        """A part's rows; none if there are none yet."""
        return self.versions.read(part, schema)

    def counts(self) -> dict[str, int]:
        """Rows of each part, from the files' footers."""
        held = self.versions.current()["parts"]
        folders = {p: [f"{self.path}/data/{f}" for f in held.get(p, [])] for p in PARTS}
        return {p: self.spark.read.parquet(*f).count() if f else 0 for p, f in folders.items()}

    def summary(self, complete: bool, partial: int = 0) -> str:
        """One line of progress; websites found so far count while the search goes on."""
        n = self.counts()
        parts = [f"{n['search_results'] + (0 if complete else partial)} websites", f"{n['crawled']} crawled", f"{n['leads']} leads"]
        if not complete:
            parts += [f"{n['completed_locations']} locations"] * bool(n["completed_locations"]) + ["search goes on"]
        return ", ".join(parts)


def run_plans(state: RunState, plans: DataFrame, keys: list[str], answer: Callable[[DataFrame], DataFrame], at_once: int = 100, enough: Callable[[int], bool] = lambda rows: False) -> int:
    """Answers plans (keys, with their order in ``ordinal``) a block at a time, and commits each block's rows together with its completed plans: how many blocks.

    answer: rows of a block of plans, as a plan of Spark. A block's commit is named by its plans, so one that was committed before the run stopped, and
    is played again, adds nothing; one that was not leaves nothing. enough: whether a number of rows ends the run.
    """
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plans.select(*keys).schema)
    done = 0
    while not enough(state.counts()["search_results"]):
        left = plans.join(state.read("completed_plans", kinds), keys, "left_anti")
        block = left.orderBy("ordinal").limit(at_once).collect()  # plans of one block
        if not block:
            break
        name = hashlib.sha256(json.dumps([[str(r[k]) for k in keys] for r in block]).encode()).hexdigest()
        own = state.spark.createDataFrame(block, left.schema)
        state.append_all({"search_results": answer(own), "completed_plans": own.select(*keys)}, name)
        done += 1
    return done


def baseline(leads: DataFrame) -> DataFrame:
    """Counters that a resumed run starts from: leads, and how many are business ones."""
    business = F.col("consent_status") == "business_public"
    return leads.agg(F.count("*").alias("leads_found"), F.count_if(business).alias("business_leads"), F.count_if(~business).alias("personal_leads"))
