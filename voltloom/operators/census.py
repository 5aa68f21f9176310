"""Ratio features of block groups, compiled from a specification."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltloom.functions import numbers, strings


@dataclass(frozen=True)
class Feature:
    """name = a sum of raw columns; 100 * sum / denominator; or log(sum + 1)."""

    name: str
    value: str
    denominator: str | None = None
    kind: str = "identity"  # identity, percent, ratio or log
    category: str = ""

    def column(self) -> Column:
        own = numbers.total(self.value)
        if self.kind == "log":
            own = numbers.log_count(own)
        elif self.kind in ("percent", "ratio"):
            if not self.denominator:
                raise ValueError(f"{self.name} needs a denominator")
            under = numbers.total(self.denominator)
            own = numbers.safe_percent(own, under) if self.kind == "percent" else F.when(under > 0, own / under)
        elif self.kind != "identity":
            raise ValueError(f"unknown kind {self.kind!r}")
        return own.alias(self.name)


def _share(name: str, value: str, of: str, category: str) -> Feature:
    return Feature(name, value, of, "percent", category)


def _terms(table: str, *numbers_: int) -> str:
    return " + ".join(f"{table}_{n:03d}E" for n in numbers_)


def _ages(*bands: tuple[int, int]) -> str:
    """Both sexes' counts of the age bands from the first to the last number (of men; women's are 24 further on)."""
    rows = [n for a, b in bands for n in range(a, b + 1)]
    return _terms("B01001", *rows, *[n + 24 for n in rows])


def _shares(table: str, whole: int, category: str, **parts: tuple[int, ...]) -> list[Feature]:
    return [_share(name, _terms(table, *own), _terms(table, whole), category) for name, own in parts.items()]


#: The 47 predictors of the second stage.
FEATURES = [
    *[Feature(n, c, category=k) for k, n, c in (("economic", "median_household_income", "B19013_001E"), ("household", "avg_household_size", "B25010_001E"), ("household", "avg_family_size", "B25010_002E"), ("demographic", "median_age", "B01002_001E"))],
    *_shares("B23025", 3, "economic", unemployment_rate=(5,)),
    *_shares("B23025", 2, "economic", pct_in_civilian_labor_force=(3,)),
    *_shares("B23025", 1, "economic", pct_not_in_labor_force=(7,)),
    *_shares("B19001", 1, "economic", pct_income_under_25k=(2, 3, 4, 5), pct_income_25k_to_75k=tuple(range(6, 13)), pct_income_75k_plus=tuple(range(13, 18))),
    *_shares("B25003", 1, "housing", pct_owner_occupied=(2,), pct_renter_occupied=(3,)),
    *_shares("B25002", 1, "housing", pct_vacant_housing_units=(3,)),
    *_shares("B25040", 1, "housing", pct_heat_utility_gas=(2,), pct_heat_electric=(5,)),
    *_shares("B25034", 1, "housing", pct_housing_built_2000_plus=(2, 3, 4, 5), pct_housing_built_1980_1999=(6, 7), old_building_pct=(8, 9, 10, 11)),
    *_shares("B25024", 1, "housing", pct_structure_single_family_detached=(2,), pct_structure_single_family_attached=(3,), pct_structure_multifamily_2_to_4=(4, 5), pct_structure_multifamily_5_to_19=(6, 7), pct_structure_multifamily_10_plus=(7, 8, 9), pct_structure_multifamily_20_plus=(8, 9), pct_structure_mobile_home=(10,)),
    *_shares("B25075", 1, "housing", pct_home_value_under_150k=tuple(range(2, 15)), pct_home_value_150k_to_299k=tuple(range(15, 20)), pct_home_value_300k_plus=tuple(range(20, 28))),
    *_shares("B25070", 1, "housing", pct_rent_burden_30_plus=(7, 8, 9, 10), pct_rent_burden_50_plus=(10,)),
    *_shares("B25091", 2, "housing", pct_owner_cost_burden_30_plus_mortgage=(8, 9, 10, 11), pct_owner_cost_burden_50_plus_mortgage=(11,)),
    *_shares("B25014", 2, "housing", pct_owner_overcrowded_2plus_per_room=(7,)),
    *_shares("B25014", 8, "housing", pct_renter_overcrowded_2plus_per_room=(13,)),
    *_shares("B11001", 1, "household", pct_single_parent_households=(6, 7)),
    *_shares("B03002", 1, "demographic", pct_white_alone=(3,), pct_black_alone=(4,), pct_asian_alone=(6,), pct_two_or_more_races=(9,)),
    *_shares("B01001", 1, "demographic", pct_female=(26,)),
    *[_share(f"pct_population_{n}", _ages(own), "B01001_001E", "demographic") for n, own in {"under_5": (3, 3), "5_to_17": (4, 6), "18_to_24": (7, 10), "25_to_44": (11, 14), "45_to_64": (15, 19), "65_plus": (20, 25)}.items()],
    _share("urban_percent", "H2_002N", "H2_002N + H2_003N", "spatial"),
]


def raw_codes(features: list[Feature]) -> list[str]:
    """All raw columns that the features need, each once, sorted."""
    return sorted({c for f in features for c in numbers.codes(f"{f.value} + {f.denominator or f.value}")})


def join_chunks(chunks: list[DataFrame], keys: list[str]) -> DataFrame:
    """Tables that hold different columns of the same places; NAME is taken from the first."""
    rest = [c.drop(*(set(c.columns) & set(chunks[0].columns) - set(keys))) for c in chunks[1:]]
    return reduce(lambda a, b: a.join(b, keys, "inner"), rest, chunks[0])


def with_geoid(raw: DataFrame) -> DataFrame:
    return raw.withColumn("GEOID", strings.geoid(F.col("state"), F.col("county"), F.col("tract"), F.col("`block group`")))


def build(raw: DataFrame, features: list[Feature], keys: tuple[str, ...] = ("GEOID",)) -> DataFrame:
    """All features in one projection. A raw column that isn't there counts as null."""
    missing = {c: F.lit(None).cast("double") for c in raw_codes(features) if c not in raw.columns}
    return raw.withColumns(missing).select(*keys, *[f.column() for f in features]) if missing else raw.select(*keys, *[f.column() for f in features])


def attach(features: DataFrame, more: DataFrame, key: str = "GEOID") -> DataFrame:
    return features.join(more, key, "left")


def validate(df: DataFrame, key: str = "GEOID", percents: list[str] | None = None, length: int = 12) -> DataFrame:
    """(metric, value): rows, distinct and ill-formed ids, and for each percentage the values outside 0 to 100."""
    percents = [c for c in df.columns if c.startswith("pct_") or c.endswith(("_pct", "_percent", "_rate"))] if percents is None else percents
    made = {"rows": F.count("*"), "unique_ids": F.countDistinct(key), "bad_id_length": F.count_if(F.length(key) != length), **{f"outside_{c}": F.count_if(~F.col(c).between(0, 100)) for c in percents}}
    return df.agg(*[v.cast("double").alias(k) for k, v in made.items()]).unpivot([], list(made), "metric", "value")
