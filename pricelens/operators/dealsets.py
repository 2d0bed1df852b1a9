"""The named sets of deals, as filters. Flags that are null count as unset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def pricing_set(deals: DataFrame) -> DataFrame:
    """Deals whose price counts: classified, no outlier, not excluded, shipping known, not free."""
    return deals.filter(~flag("unclassified") & (F.col("outlier_flag") == "NONE") & ~flag("permanently_excluded") & ~flag("shipping_unknown") & ~flag("free_price"))


def occurrence_set(deals: DataFrame) -> DataFrame:
    """Deals that count as having happened: classified, not too dear, not a rejected cheap one."""
    return deals.filter(~flag("unclassified") & (F.col("outlier_flag") != "UPPER") & ~((F.col("outlier_flag") == "LOWER") & flag("permanently_excluded")))


def signal_set(deals: DataFrame) -> DataFrame:
    """Deals that are on: classified, no outlier, not ended."""
    return deals.filter(~flag("unclassified") & (F.col("outlier_flag") == "NONE") & (F.col("status") != "ENDED"))
