"""The reference's function names.

Where only the name differs, the name is bound to the operator; a function stands here only where the
arguments differ.  Data is a DataFrame plus column names instead of free-standing Series (rows have no
positions in Spark, so a target or stratum is a column of the same frame), and chart functions return
the aggregate behind the chart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsieve.functions import similarity as _similarity
from tabsieve.functions import text as _text
from tabsieve.operators import binning, cleaning, distribution, encoding, freq, fuzzy, profile, splitting
from tabsieve.sources import csv as _csv
from tabsieve.sources import reports as _reports

load_dataset = _csv.read_csv
save_category_audit_report = _reports.save_category_audit
get_categorical_columns = freq.categorical_columns
build_category_table, build_category_summary = freq.category_table, freq.category_summary
plot_categorical_counts = freq.top_n_other
explore_target, explore_features = profile.explore_target, profile.explore_features
duplicate_rows_summary, get_constant_columns = profile.duplicate_rows, profile.constant_columns
missing_values_summary = plot_missing_values = profile.missing_summary
unique_values_summary = plot_unique_values = profile.unique_summary
normalize_category_text, normalize_text, text_similarity = (_text.normalize_category, _text.normalize_text,
                                                            _similarity.similarity)
find_semantic_repetitions, suggest_category_mapping = fuzzy.semantic_repetitions, fuzzy.suggest_category_mapping
apply_category_mapping, apply_semantic_mapping = cleaning.apply_category_mapping, cleaning.apply_semantic_mapping
invert_category_map, drop_irrelevant_columns = cleaning.inverted_category_map, cleaning.drop_columns
remove_invalid_values, convert_peso_prices_to_usd = cleaning.remove_invalid_values, cleaning.convert_currency
encode_camera_retroceso, one_hot_encoding = cleaning.encode_binary, encoding.one_hot_encoding
split_stratum_indices, make_price_bins = splitting.split_sizes, binning.quantile_bins
make_brand_price_strata = binning.brand_price_strata
plot_price_distribution_by_currency = distribution.histogram_by_group
plot_raw_numeric_distributions = distribution.raw_distributions
plot_camera_missing_by_year = distribution.missing_by_group


def format_value_counts(freq_table: DataFrame, max_items: int) -> DataFrame:
    """D4 on a frequency table ``(feature, category, count)``: per feature the ``"cat: n | ..."``
    preview of its ``max_items`` most frequent categories (count desc, category asc)."""
    w = Window.partitionBy("feature").orderBy(F.desc("count"), F.asc("category"))
    top = (freq_table.where(F.col("category").isNotNull())
                     .withColumn("k", F.row_number().over(w)).where(F.col("k") <= max_items))
    return top.groupBy("feature").agg(
        freq._preview(F.collect_list(F.struct("k", "category", "count"))).alias("preview"))


def safe_index(split_df: DataFrame, part: str, split_col: str = "split") -> DataFrame:
    """Rows of one split part (``"train"`` / ``"validation"``), selected by label instead of by index arrays."""
    return split_df.where(F.col(split_col) == part).drop(split_col)


def train_val_split_stratified(df: DataFrame, target: str, stratify_by: str, key_cols: Sequence[str],
                               train_size: float = 0.80, random_state: int = 42):
    """``((X_train, y_train), (X_val, y_val))``; every part keeps ``key_cols`` so X and y re-align by join."""
    split = splitting.stratified_split(df, stratify_by, key_cols, train_size, random_state)
    labels = list(dict.fromkeys([*key_cols, target]))
    return tuple((part.drop(target), part.select(*[F.col(f"`{c}`") for c in labels]))
                 for part in (splitting.train_part(split), splitting.validation_part(split)))


def plot_currency_counts(df: DataFrame, currency_col: str) -> DataFrame:
    """Counts of a column with its missing values."""
    return freq.value_counts(df, currency_col, dropna=False)


def plot_preliminary_outliers(df: DataFrame, numeric_cols: Sequence[str], currency_col: str | None = None,
                              price_col: str | None = None) -> DataFrame:
    """Box-plot statistics, the price split by currency."""
    return distribution.boxplot_stats(df, numeric_cols, currency_col, [price_col] if price_col else [])
