"""Identity-cluster features: fitted on history, applied to new rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwatch.functions.scalar import any_flag, clip, sum_of_flags
from stallwatch.operators.aggregates import cluster_sizes, with_cluster_size


@dataclass(frozen=True)
class ClusterFeatures:
    """Estimator: counts rows per identity. Small clusters suggest rings, very large ones power users."""

    identities: Sequence[str]
    small_from: int = 2
    small_to: int = 4
    power_from: int = 10
    cap: int = 100

    def fit(self, df: DataFrame) -> "ClusterModel":
        return ClusterModel(self, {c: cluster_sizes(df, c, "__size") for c in self.identities if c in df.columns})


@dataclass(frozen=True)
class ClusterModel:
    settings: ClusterFeatures
    sizes: dict[str, DataFrame]

    def transform(self, df: DataFrame) -> DataFrame:
        """Per identity: small-cluster flag, power-user flag, clipped size; over identities: counts and any-small."""
        s, out, names = self.settings, df, []
        for identity, sizes in self.sizes.items():
            if identity not in df.columns:
                continue
            name = identity.replace("/", "_").removesuffix("_hash")
            names.append(name)
            size = F.col("__size")
            out = with_cluster_size(out, sizes, identity, "__size").withColumns(
                {
                    f"cf_{name}_is_small_cluster": F.coalesce(size.between(s.small_from, s.small_to), F.lit(False)),
                    f"cf_{name}_is_power_user": F.coalesce(size >= s.power_from, F.lit(False)),
                    f"cf_{name}_cluster_size": clip(size, 1, s.cap, 1).cast("int"),
                }
            ).drop("__size")
        small = [f"cf_{n}_is_small_cluster" for n in names]
        power = [f"cf_{n}_is_power_user" for n in names]
        return out.withColumns(
            {"cf_small_cluster_count": sum_of_flags(small), "cf_any_small_cluster": any_flag(small), "cf_power_user_count": sum_of_flags(power)}
        ) if names else out


def training_cluster_features(df: DataFrame, settings: ClusterFeatures) -> DataFrame:
    """Training mode: rows are measured against their own table's counts."""
    return settings.fit(df).transform(df)
