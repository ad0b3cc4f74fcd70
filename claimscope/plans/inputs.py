"""Where the registered queries get their tables from.

``Inputs`` hands out the fact view and its dimensions for one data folder.
By default they are the lazy views over the driver's tables
(:mod:`claimscope.sources.fixture`); ``Inputs.from_build`` points them at the
Parquet tables written by the batch build (:mod:`claimscope.plans.build`)
instead, which is what a deployment queries.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from claimscope.functions.filters import Filter
from claimscope.sources import fixture
from claimscope.sources.interleaved import helps


@dataclass
class Inputs:
    spark: SparkSession
    sf_dir: str
    built: str | None = None
    _cache: dict = field(default_factory=dict)

    @classmethod
    def from_build(cls, spark: SparkSession, root: str) -> "Inputs":
        """The tables of the latest complete build under ``root``."""
        from claimscope.sources.tables import latest_build
        return cls(spark, sf_dir="", built=latest_build(spark, root))

    def _get(self, name, make):
        if name not in self._cache:
            self._cache[name] = make()
        return self._cache[name]

    def fact(self) -> DataFrame:
        """billing_npi, servicing_npi, hcpcs, month, patients, claim_lines,
        paid DECIMAL(18,2), billing_state (+ hcpcs_norm when built)."""
        if self.built:
            from claimscope.sources.tables import fact_at
            return self._get("fact", lambda: fact_at(self.spark, self.built))
        return self._get("fact", lambda: fixture.spending(self.spark, self.sf_dir))

    def fact_for(self, flt: Filter) -> DataFrame:
        """The fact in the layout that prunes best under a filter: the interleaved copy
        where a build has it and the filter names no code."""
        if not self.built or not helps(flt):
            return self.fact()
        from claimscope.sources.tables import fact_at, table_exists
        if not table_exists(self.spark, f"{self.built}/fact_interleaved"):
            return self.fact()
        return self._get("fact_interleaved", lambda: fact_at(self.spark, self.built, "fact_interleaved"))

    def raw(self) -> DataFrame:
        return self._get("raw", lambda: fixture.spending_raw(self.spark, self.sf_dir))

    def lookup(self) -> DataFrame:
        """npi, name, state."""
        if self.built:
            return self._get("lookup", lambda: self.spark.read.parquet(f"{self.built}/npi_lookup"))
        return self._get("lookup", lambda: fixture.npi_lookup(self.spark, self.sf_dir))

    def sectors(self) -> DataFrame:
        """hcpcs, sector (classified codes only)."""
        if self.built:
            return self._get("sectors", lambda: self.spark.read.parquet(f"{self.built}/sector_map"))
        from claimscope.functions.sectors import code_sectors
        return self._get("sectors", lambda: code_sectors(self.fact(), "hcpcs"))

    def cube(self, name: str, make) -> DataFrame:
        """A materialised aggregate: the table baked from this build's fact if
        there is one, else ``make(fact)`` computed on the fly."""
        baked = self.stored(name)
        return self._get(name, lambda: make(self.fact())) if baked is None else baked

    def stored(self, name: str) -> DataFrame | None:
        """A table baked with this build, if it is there."""
        if not self.built:
            return None
        from claimscope.sources.tables import table_exists
        path = f"{self.built}/{name}"
        if not table_exists(self.spark, path):
            return None
        return self._get(name, lambda: self.spark.read.parquet(path))

    def descs(self) -> DataFrame:
        """hcpcs, name."""
        if self.built:
            return self._get("descs", lambda: self.spark.read.parquet(f"{self.built}/code_desc"))
        return self._get("descs", lambda: fixture.code_desc(self.spark, self.sf_dir))
