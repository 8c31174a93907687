"""Recipes: an ordered list of ``{type, config}`` steps folded into one lazy plan."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..config import DEFAULTS
from ..functions.names import ROW_ID, SORT_KEY, c, drop_hidden, require
from ..functions.ordering import RowOrder
from ..operators import clean, dates, finance, shape
from ..operators.aggregate import ORDERED, group_by_aggregate
from ..operators.dates import tie_breakers
from ..operators.dedup import KEEP_NONE, drop_duplicates
from ..operators.joins import join_on_common_columns, join_tables
from ..operators.quality import detect_outliers, validate_regex
from ..operators.union import consolidate_periods
from ..sources.preview import PAGE_ROWS, preview
from ..sources.readers import read_table
from .audit import StepLog


@dataclass
class _State:
    """What a step may read besides the table, and the row order steps hand on."""

    join_table: DataFrame | None = None
    tables: Sequence[DataFrame] = ()
    order: RowOrder | None = None
    # The last sort asked for and not yet overruled; it is carried out once, at the end.
    sorted_by: RowOrder | None = None

    def forget_order(self) -> None:
        self.order = self.sorted_by = None


@dataclass(frozen=True)
class Step:
    run: Callable[[_State, DataFrame, Mapping], DataFrame]
    streamable: bool = True


STEPS: dict[str, Step] = {}


def step(name: str, streamable: bool = True):
    def register(run):
        STEPS[name] = Step(run, streamable)
        return run

    return register


# Text


@step("trimWhitespace")
def _trim(state, df, cfg):
    return clean.trim_whitespace(df, cfg.get("columns"))


@step("lowercaseText")
def _lower(state, df, cfg):
    return clean.lowercase_text(df, cfg.get("columns", []))


@step("removeSymbols")
def _symbols(state, df, cfg):
    return clean.remove_symbols(
        df, cfg.get("columns", []), cfg.get("keep_chars") or clean.KEEP_CHARS
    )


@step("replaceValues")
def _replace(state, df, cfg):
    return clean.replace_values(
        df,
        cfg.get("columns", []),
        cfg.get("to"),
        cfg.get("value", ""),
        regex=bool(cfg.get("regex", False)),
        case_sensitive=bool(cfg.get("case", True)),
    )


@step("splitCombinedField")
def _split(state, df, cfg):
    return clean.split_field(
        df,
        cfg.get("source"),
        cfg.get("into", []),
        cfg.get("delimiter", ","),
        int(cfg.get("maxsplit", -1)),
        bool(cfg.get("strip", True)),
    )


@step("mergeColumns")
def _merge(state, df, cfg):
    return clean.merge_columns(
        df,
        cfg.get("cols", []),
        cfg.get("dest", "Merged"),
        cfg.get("sep", " "),
        bool(cfg.get("drop_source", False)),
    )


@step("currencyToFloat")
def _currency(state, df, cfg):
    return clean.currency_to_float(df, cfg.get("columns", []))


# Dates and order


@step("standardizeDate")
def _standardize(state, df, cfg):
    columns = cfg.get("columns") or [cfg.get("col", DEFAULTS.date)]
    options = {name: cfg[name] for name in ("formats", "dayfirst") if cfg.get(name) is not None}
    return dates.standardize_date(df, columns, **options)


@step("filterDateRange")
def _date_range(state, df, cfg):
    return dates.filter_date_range(
        df, cfg.get("col", DEFAULTS.date), cfg.get("from"), cfg.get("to"), dayfirst=cfg.get("dayfirst")
    )


@step("sortByDate", streamable=False)
def _sort(state, df, cfg):
    (column,) = require(df, [cfg.get("col", DEFAULTS.date)])
    # Only the key is kept here: the one sort happens at the end, on its value at this step.
    keys = (SORT_KEY, ROW_ID) if ROW_ID in df.columns else (SORT_KEY,)
    state.order = state.sorted_by = RowOrder(keys, cfg.get("order", "asc") == "desc")
    return df.withColumn(SORT_KEY, c(column))


@step("flagWeekend")
def _weekend(state, df, cfg):
    return dates.flag_weekend(df, cfg.get("col"), cfg.get("dest", "Weekend"))


# Finance


@step("calculateGrossProfit")
def _gross(state, df, cfg):
    return finance.gross_profit(
        df, cfg.get("revenue_col"), cfg.get("cogs_col"), cfg.get("output_col", "Gross Profit")
    )


@step("calculateNetProfit")
def _net(state, df, cfg):
    return finance.net_profit(
        df,
        cfg.get("revenue_col"),
        cfg.get("cogs_col"),
        cfg.get("expenses_col"),
        cfg.get("output_col", "Net Profit"),
    )


@step("aggregatePLByPeriod", streamable=False)
def _pl(state, df, cfg):
    out = finance.pl_by_period(
        df,
        cfg.get("date_col"),
        cfg.get("freq", "M"),
        cfg.get("revenue_col"),
        cfg.get("cogs_col"),
        cfg.get("expenses_col"),
    )
    state.order, state.sorted_by = RowOrder(("Period",)), None
    return out


@step("flagHighValue")
def _high_value(state, df, cfg):
    return finance.flag_high_value(
        df,
        cfg.get("value_column"),
        float(cfg.get("threshold") or 10000.0),
        cfg.get("dest", "High Value"),
    )


@step("flagNegativeProfit")
def _negative(state, df, cfg):
    return finance.flag_negative_profit(
        df, cfg.get("col", "Net Profit"), cfg.get("dest", "Negative Profit")
    )


# Rows and columns


@step("filterExpr")
def _filter(state, df, cfg):
    return shape.filter_expr(df, cfg.get("expr", ""))


@step("filterDebitCredit")
def _types(state, df, cfg):
    column, target = cfg.get("col", DEFAULTS.type), DEFAULTS.type
    if column != target and column in df.columns:
        if target in df.columns:
            raise ValueError(f"cannot rename {column!r}: the table already has {target!r}")
        df = shape.rename_columns(df, {column: target})
    return shape.filter_types(df, target, cfg.get("include", []))


@step("deleteBlankRows")
def _blank(state, df, cfg):
    return shape.delete_blank_rows(df, cfg.get("subset"))


@step("addColumnFormula")
def _formula(state, df, cfg):
    return shape.add_formula(df, cfg.get("dest", "Result"), cfg.get("expr"))


@step("renameColumns")
def _rename(state, df, cfg):
    return shape.rename_columns(df, cfg.get("names", {}))


# Several rows or tables


@step("groupByAggregate", streamable=False)
def _group(state, df, cfg):
    by, aggs = cfg.get("by", []), cfg.get("aggs", {})
    out = group_by_aggregate(
        df, by, aggs, bool(cfg.get("dropna", False)), cfg.get("order_by") or state.order
    )
    state.order, state.sorted_by = RowOrder((by,) if isinstance(by, str) else tuple(by)), None
    return out


@step("dropDuplicates", streamable=False)
def _dedup(state, df, cfg):
    return drop_duplicates(
        df, cfg.get("subset"), cfg.get("keep", "first"), cfg.get("order_by") or state.order
    )


@step("joinWithFile")
def _join(state, df, cfg):
    if state.join_table is None:
        raise ValueError("joinWithFile needs a second table (join_table)")
    how = cfg.get("how", "left")
    out = join_tables(df, state.join_table, cfg.get("key") or [], how, cfg.get("suffixes", ["_a", "_b"]))
    if how in ("right", "outer"):
        state.forget_order()
        out = drop_hidden(out)
    return out


@step("joinOnCommonColumns", streamable=False)
def _join_common(state, df, cfg):
    others = list(state.tables) or ([state.join_table] if state.join_table is not None else [])
    out = join_on_common_columns(
        [drop_hidden(df), *others],
        cfg.get("on"),
        cfg.get("how", "outer"),
        cfg.get("suffixes", ["_x", "_y"]),
    )
    state.forget_order()
    return out


@step("consolidateMonthEnd", streamable=False)
def _consolidate(state, df, cfg):
    date = cfg.get("date_col", DEFAULTS.date)
    out = consolidate_periods(
        [drop_hidden(df), *state.tables],
        date,
        bool(cfg.get("add_period_col", True)),
        cfg.get("period_col", "Period"),
        cfg.get("freq", "M"),
        sort=False,
    )
    state.order = state.sorted_by = RowOrder((SORT_KEY,))
    return out.withColumn(SORT_KEY, c(date))


@step("detectOutliers", streamable=False)
def _outliers(state, df, cfg):
    return detect_outliers(df, cfg.get("columns", []), float(cfg.get("k", 1.5)))


@step("validateRegex")
def _validate(state, df, cfg):
    if not cfg.get("column") or not cfg.get("pattern"):
        raise ValueError("validateRegex needs 'column' and 'pattern'")
    return validate_regex(df, cfg["column"], cfg["pattern"], cfg.get("mark_col"))


# Running


@dataclass
class RecipeResult:
    df: DataFrame
    log: list[dict]
    _unsorted: DataFrame = field(repr=False)
    _order: RowOrder | None = field(repr=False)
    _steps: StepLog = field(repr=False)

    def preview(
        self, limit: int = PAGE_ROWS, offset: int = 0, order_by: Sequence[str] | None = None
    ) -> DataFrame:
        """One page in the order the steps left, or in the one given, as a top-k."""
        return preview(self._unsorted, limit, offset, order_by or self._order)

    def resolve_log(self) -> list[dict]:
        """The log with observed row counts, after a full action (audit="observe")."""
        return self._steps.resolve()


# What a step can raise while it is built; Spark analyses each step at once, so a missing
# column or a bad expression shows here and not in the action.
STEP_ERRORS = (PySparkException, ValueError, TypeError, KeyError, AttributeError)


def steps_of(recipe) -> list[Mapping]:
    """The step list of a bare list, of ``{"steps": [...]}`` or of a saved template."""
    if isinstance(recipe, str):
        recipe = json.loads(recipe)
    if isinstance(recipe, Mapping):
        recipe = recipe.get("recipe", recipe.get("steps", []))
    return list(recipe or [])


def load_recipe(path: str) -> list[Mapping]:
    """Steps of a saved template or recipe file (JSON)."""
    with open(path, encoding="utf-8") as source:
        return steps_of(json.load(source))


def needs_order(recipe) -> bool:
    """Whether a step depends on row order and does not name it itself."""
    for item in steps_of(recipe):
        cfg = item.get("config") or {}
        if cfg.get("order_by"):
            continue
        if item.get("type") == "dropDuplicates" and cfg.get("subset"):
            if cfg.get("keep", "first") not in KEEP_NONE:
                return True
        if item.get("type") == "groupByAggregate":
            listed = [[f] if isinstance(f, str) else f for f in cfg.get("aggs", {}).values()]
            if any(fn in ORDERED for fns in listed for fn in fns):
                return True
    return False


def run_recipe(
    df: DataFrame,
    recipe,
    join_table: DataFrame | None = None,
    tables: Sequence[DataFrame] = (),
    order_by: Sequence[str] | None = None,
    audit: str = "off",
    context: Mapping | None = None,
) -> RecipeResult:
    """Fold the steps over ``df`` without running a job.

    An unknown step changes nothing and is logged; a failing one leaves the table as it
    was, and the run goes on. ``order_by`` states the order of the input rows for steps
    that need one; tables read with ``ordinal=True`` carry it. A sort is carried out once,
    after the last step, unless a later step gives the rows another order.
    """
    state = _State(join_table, tables)
    if order_by:
        # Kept beside the columns it is made of, which later steps may change or drop.
        df = df.withColumn(ROW_ID, RowOrder(tuple(require(df, order_by))).rank_key())
    log = StepLog(audit, context or {})
    out = log.start(df)
    for index, item in enumerate(steps_of(recipe)):
        known = STEPS.get(item.get("type"))
        before = (state.order, state.sorted_by)
        try:
            if known and df.isStreaming and not known.streamable:
                raise ValueError(f"step {item.get('type')!r} does not run on a stream")
            changed = known.run(state, out, item.get("config") or {}) if known else out
            out = log.done(index, item, _order_kept(state, out, changed))
        except STEP_ERRORS as error:
            state.order, state.sorted_by = before
            log.failed(index, item, error)
    ordered = out
    if state.sorted_by is not None:
        keys = state.sorted_by.columns()
        if ROW_ID not in out.columns:
            keys += tie_breakers(out.drop(SORT_KEY))
        # A sort first samples its input; behind a shuffle, observed rows are counted once.
        ordered = (out.hint("rebalance") if audit == "observe" else out).orderBy(*keys)
    return RecipeResult(drop_hidden(ordered), log.entries, out, state.order, log)


def _order_kept(state: _State, before: DataFrame, after: DataFrame) -> DataFrame:
    """Forget an order whose columns a step removed."""
    if state.order is not None and not set(state.order.keys) <= set(after.columns):
        state.order = None
    if state.sorted_by is not None and SORT_KEY not in after.columns:
        state.sorted_by = None
    return after


def run_recipe_file(
    spark: SparkSession, recipe_path: str, table_path: str, join_path: str | None = None, **options
) -> RecipeResult:
    """Read the tables and run a saved recipe.

    Row positions are read only if a step depends on them. A sort does: they keep equal
    rows in file order, and let even exact copies spread over tasks.
    """
    recipe = load_recipe(recipe_path)
    sorts = any(item.get("type") == "sortByDate" for item in recipe)
    table = read_table(spark, table_path, ordinal=sorts or needs_order(recipe))
    other = read_table(spark, join_path) if join_path else None
    return run_recipe(table, recipe, join_table=other, **options)


def dedup_steps(recipe) -> list[dict]:
    """Steps that differ in type or configuration, first occurrences, in order."""
    seen, out = set(), []
    for item in steps_of(recipe):
        plain = {"type": item.get("type"), "config": item.get("config") or {}}
        mark = json.dumps(plain, sort_keys=True, default=str)
        if mark not in seen:
            seen.add(mark)
            out.append(plain)
    return out
