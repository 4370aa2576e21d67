"""Model-ready tables: derived columns, conforming to an ordered list, numeric preparation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwatch.functions.scalar import first_number, flag_bit, time_features
from stallwatch.operators.joins import category_dictionary, encode_categories
from stallwatch.registry import AREA_COLUMNS, PRICE_COLUMNS, Registry, Role


def derive_base(df: DataFrame, registry: Registry = Registry()) -> DataFrame:
    """Price, area, time features and 0/1 flags, in one projection."""
    out: dict[str, Column] = {"feature_price": first_number(df, PRICE_COLUMNS), "feature_area": first_number(df, AREA_COLUMNS)}
    for time in registry.of(Role.TIME):
        out.update(time_features(time) if time in df.columns else {})
    out.update({c: flag_bit(F.col(f"`{c}`")) for c in registry.of(Role.FLAG) if c in df.columns})
    return df.withColumns(out)


def conform(df: DataFrame, ordered: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Exactly the ordered columns: a missing count becomes 0, any other missing column null; numbers cast leniently."""
    numeric = set(numbers)

    def column(name: str) -> Column:
        if name not in df.columns:
            value = F.lit(0.0) if "count" in name else F.lit(None).cast("double" if name in numeric else "string")
        else:
            value = F.col(f"`{name}`").try_cast("double") if name in numeric else F.col(f"`{name}`")
        return value.alias(name)

    return df.select(*[column(c) for c in ordered])


def encode_for_model(df: DataFrame, categories: Sequence[str], dictionary: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Ordinal codes for categories; learns the dictionary from ``df`` unless one is given (then unseen is null)."""
    present = [c for c in categories if c in df.columns]
    dictionary = category_dictionary(df, present) if dictionary is None else dictionary
    return encode_categories(df, dictionary, present), dictionary


def numeric_stages(columns: Sequence[str], output: str = "features", *, scale: bool = True) -> list:
    """Assemble prepared columns and optionally centre and scale them."""
    assembled = VectorAssembler(inputCols=list(columns), outputCol="__raw" if scale else output, handleInvalid="error")
    if not scale:
        return [assembled]
    return [assembled, StandardScaler(inputCol="__raw", outputCol=output, withMean=True, withStd=True)]


def fill_numbers(df: DataFrame, columns: Sequence[str], value: float = 0.0) -> DataFrame:
    """Constant imputation; NaN counts as missing."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)), F.lit(value)) for c in columns})


def with_missing_flags(df: DataFrame, columns: Sequence[str], suffix: str = "_missing") -> tuple[DataFrame, list[str]]:
    """Value filled with 0 plus an indicator, for trees without a missing-value branch; NaN counts as missing."""
    missing = {c: F.col(f"`{c}`").isNull() | F.coalesce(F.isnan(F.col(f"`{c}`").try_cast("double")), F.lit(False)) for c in columns}
    flags = {c + suffix: m.cast("double") for c, m in missing.items()}
    return fill_numbers(df.withColumns(flags), columns), [*columns, *flags]


def scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Impute with 0 and standardise; adds a ``features`` vector."""
    filled = fill_numbers(df, columns)
    return Pipeline(stages=numeric_stages(columns)).fit(filled).transform(filled)
