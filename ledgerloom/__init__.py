"""Data preparation and profit-and-loss analytics as Spark plans."""

from .config import DEFAULTS, ColumnDefaults
from .operators.aggregate import group_by_aggregate
from .operators.clean import (
    currency_to_float,
    lowercase_text,
    merge_columns,
    remove_symbols,
    replace_values,
    split_field,
    trim_whitespace,
)
from .operators.dates import filter_date_range, flag_weekend, sort_by_date, standardize_date
from .operators.dedup import drop_duplicates
from .operators.finance import (
    flag_high_value,
    flag_negative_profit,
    gross_profit,
    net_profit,
    pl_by_period,
    pl_summary,
)
from .operators.joins import (
    join_on_common_columns,
    join_report,
    join_tables,
    simulate_join,
    suggest_join_keys,
)
from .operators.profile import (
    currency_shares,
    detect_currency_columns,
    hit_rates,
    profile,
)
from .operators.quality import (
    detect_outliers,
    outlier_fences,
    validate_regex,
    validate_rules,
)
from .operators.quantiles import exact_quantiles
from .operators.shape import (
    add_formula,
    delete_blank_rows,
    filter_expr,
    filter_types,
    rename_columns,
)
from .operators.union import consolidate_periods, union_identical
from .plans.audit import log_table
from .plans.recipe import (
    RecipeResult,
    dedup_steps,
    load_recipe,
    needs_order,
    run_recipe,
    run_recipe_file,
)
from .plans.suggest import propose_recipe, recommend, suggest
from .session import configure
from .sources.preview import describe, describe_tables, preview, sample_records, select_tables
from .sources.readers import detect_format, read_csv, read_json, read_parquet, read_table
from .sources.writers import export_bundle, write_csv, write_json, write_parquet

__all__ = [name for name in dir() if not name.startswith("_")]
