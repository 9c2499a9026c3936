"""Quantile bins and strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsieve.functions.labels import NA_BIN as NA_LABEL
from tabsieve.functions.labels import OTHER_CATEGORY as OTHER_LABEL
from tabsieve.functions.labels import PRICE_BIN_JOIN
from tabsieve.functions.labels import UNKNOWN_STRATUM as UNKNOWN_LABEL
from tabsieve.functions.missing import to_number
from tabsieve.operators.freq import as_text
from tabsieve.operators.lookup import lookup
from tabsieve.operators.ordering import exact_quantiles, linspace_probs


def quantile_edges(df: DataFrame, column: str, n_bins: int) -> list[float]:
    """Distinct linear-interpolated quantile edges at ``linspace(0, 1, n_bins + 1)`` (a one-row,
    ``n_bins + 1``-value statistic, the only thing collected)."""
    x = to_number(F.col(f"`{column}`"), df.schema[column].dataType)
    aliases = [f"e{i}" for i in range(n_bins + 1)]
    row = exact_quantiles(df.select(x.alias("v")), [], "v", linspace_probs(n_bins), aliases).collect()
    if not row:
        return []
    return sorted({row[0][a] for a in aliases if row[0][a] is not None})


def bin_code(x: Column, edges: list[float]) -> Column:
    """Index of the right-closed bin ``(e[i], e[i+1]]`` holding ``x`` (the lowest edge included);
    NULL for NULL, out-of-range values, or fewer than two distinct edges (``pd.qcut`` with
    ``duplicates="drop"``)."""
    if len(edges) < 2:
        return F.lit(None).cast("int")
    e = F.array(*[F.lit(float(v)) for v in edges])
    inside = (x >= F.lit(float(edges[0]))) & (x <= F.lit(float(edges[-1])))
    code = F.when(x == F.lit(float(edges[0])), F.lit(0)).otherwise(
        F.size(F.filter(e, lambda q: q < x)) - 1)
    return F.when(inside, code).cast("int")


def quantile_bins(df: DataFrame, column: str, n_bins: int = 5, out_col: str = "price_bin") -> DataFrame:
    """H1: ``pd.qcut(labels=False, duplicates="drop")`` as text labels ``"0".."k"``, NULL -> ``<NA>``."""
    edges = quantile_edges(df, column, n_bins)
    x = to_number(F.col(f"`{column}`"), df.schema[column].dataType)
    code = bin_code(x, edges)
    return df.withColumn(out_col, F.coalesce(code.cast("string"), F.lit(NA_LABEL)))


def collapse_rare(df: DataFrame, column: str, min_count: int, other: str = OTHER_LABEL,
                  out_col: str | None = None) -> DataFrame:
    """D20 / E4 (N1): values seen fewer than ``min_count`` times become ``other``.

    Counting is a grouped count (partial aggregation, so a huge value is one row per task); only the
    rare values are joined back, by a size-checked lookup."""
    out_col = out_col or column
    c = F.col(f"`{column}`")
    rare = (df.groupBy(c.alias("_val")).agg(F.count(F.lit(1)).alias("_n"))
              .where(F.col("_n") < min_count).select("_val", F.lit(True).alias("_rare")))
    joined = lookup(df, c, rare, "_val", F.struct(*[F.col(f"`{n}`") for n in df.columns]))
    return joined.withColumn(out_col, F.when(F.col("_rare"), F.lit(other)).otherwise(c)).drop("_rare")


def brand_price_strata(df: DataFrame, brand_col: str, price_col: str, n_price_bins: int = 4,
                       min_count: int = 10, out_col: str = "stratum") -> DataFrame:
    """H2: ``brand + "_price_bin_" + bin`` (NULL brand -> ``Unknown``, NULL bin -> ``<NA>``); strata
    with fewer than ``min_count`` rows become ``Other``."""
    binned = quantile_bins(df, price_col, n_price_bins, out_col="_bin")
    brand = F.coalesce(as_text(binned, brand_col), F.lit(UNKNOWN_LABEL))
    labelled = binned.withColumn(out_col, F.concat(brand, F.lit(PRICE_BIN_JOIN), F.col("_bin"))).drop("_bin")
    return collapse_rare(labelled, out_col, min_count)
