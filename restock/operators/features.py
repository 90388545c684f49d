"""Window features of the training matrix.

All rolling, look-ahead and seasonal columns are frames over one window (series, ordered by day),
so a whole matrix costs a single shuffle and sort. A series holds at most one row per day, which
bounds every window partition by the length of the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from restock.functions.dates import calendar_columns, is_leap_day
from restock.functions.numeric import ewm_last, ratio
from restock.operators.frames import SERIES, over_days, rows_of_series, value_in_days

WINDOWS = (3, 7, 14, 21, 28)
# whole-year distances in days, by number of leap days crossed
_YEAR_DAYS = {1: (365, 366), 2: (730, 731), 3: (1095, 1096)}


def add_calendar(df: DataFrame, day: str = "c_date") -> DataFrame:
    return df.withColumns(calendar_columns(F.col(day)))


def rolling_columns(
    target: str,
    windows: Sequence[int] = WINDOWS,
    keys: Sequence[str] = SERIES,
    day: str = "c_date",
) -> dict[str, Column]:
    """Mean, median, spread, extremes, mean step and max/mean ratio for each window length."""
    value = F.col(target)
    columns: dict[str, Column] = {}
    # the longest window's values in day order; those of a shorter one are its last ones
    recent = over_days(f"collect_list({target})", 1 - max(windows), 0, keys, day)
    for days in windows:
        def stat(call: str, first: int = 1 - days) -> Column:
            return over_days(call, first, 0, keys, day)

        n, mean, top = stat(f"count({target})"), stat(f"avg({target})"), stat(f"max({target})")
        tag = f"{days}d_{target}"
        columns[f"mean_{tag}"] = mean
        ordered = F.sort_array(F.slice(recent, F.size(recent) - n.cast("int") + 1, n.cast("int")))
        middle = [F.get(ordered, F.floor((n + k) / 2).cast("int")) for k in (-1, 0)]
        columns[f"median_{tag}"] = (middle[0] + middle[1]) / 2
        columns[f"std_{tag}"] = stat(f"stddev_samp({target})")
        columns[f"min_{tag}"] = stat(f"min({target})")
        columns[f"max_{tag}"] = top
        # consecutive steps telescope to (last - first); undefined for a single row
        columns[f"diff_mean_{tag}"] = F.when(n > 1, (value - stat(f"first({target})")) / (n - 1))
        columns[f"max_mean_ratio_{tag}"] = ratio(top, mean)
    return columns


def rolling_ewm(
    target: str, days: int, keys: Sequence[str] = SERIES, day: str = "c_date", alpha: float = 0.9
) -> Column:
    """Exponentially weighted mean over the last ``days`` days (at most that many values)."""
    return ewm_last(trailing_list(target, days, keys, day), alpha)


def yearly_ewm(
    target: str, keys: Sequence[str] = SERIES, day: str = "c_date", alpha: float = 0.9
) -> Column:
    """EWM of the same day-of-year over the three calendar years ending today.

    The same day-of-year lies 365 or 366 days back per year, so each earlier value is a zero-width
    frame; a value counts only when its day-of-year really matches and it is younger than three
    calendar years.
    """
    here = F.col(day)
    oldest = F.add_months(here, -36)

    def years_back(n: int) -> Column:
        picks = []
        for gap in _YEAR_DAYS[n]:
            then = F.date_sub(here, gap)
            same = (F.dayofyear(then) == F.dayofyear(here)) & (F.year(then) == F.year(here) - n)
            found = value_in_days(target, -gap, keys, day)
            picks.append(F.when(same & (then > oldest), found))
        return F.coalesce(*picks)

    history = F.array(years_back(3), years_back(2), years_back(1), F.col(target))
    return ewm_last(F.filter(history, lambda x: x.isNotNull()), alpha)


def seasonal_lookup(
    source: str, horizon: int, keys: Sequence[str] = SERIES, day: str = "c_date"
) -> Column:
    """``source`` one year before ``day + horizon``; NULL where that day is a Feb 29 or has no row.

    Reading the row ``365 - h`` or ``366 - h`` days back equals joining on the date one year later
    minus ``h`` days, and each row matches at most once.
    """
    target_day = F.date_add(F.col(day), horizon)
    gap = F.datediff(target_day, F.add_months(target_day, -12))
    found = F.when(gap == 365, value_in_days(source, horizon - 365, keys, day)).otherwise(
        value_in_days(source, horizon - 366, keys, day)
    )
    return F.when(~is_leap_day(target_day), found)


def forward_fill(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = SERIES, day: str = "c_date"
) -> DataFrame:
    """Replace a NULL by the last known value of the same series."""
    past = rows_of_series(keys, day).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(past) for c in columns})


def window_features(
    df: DataFrame,
    target: str = "log_units_sold",
    horizon: int = 7,
    windows: Sequence[int] = WINDOWS,
    keys: Sequence[str] = SERIES,
    day: str = "c_date",
) -> DataFrame:
    """Calendar, rolling and seasonal columns of every row."""
    yearly = f"ewm_3y_{target}"
    rolled = add_calendar(df, day).withColumns(
        {**rolling_columns(target, windows, keys, day), yearly: yearly_ewm(target, keys, day)}
    )
    looked = {
        f"h{h}_{yearly}": seasonal_lookup(yearly, h, keys, day) for h in range(1, horizon + 1)
    }
    return rolled.withColumns(looked).drop(yearly)


def feature_matrix(
    snapshot: DataFrame,
    split_date: str,
    target: str = "log_units_sold",
    horizon: int = 7,
    split_first: bool = False,
) -> DataFrame:
    """Snapshot plus features, targets forward-filled, with ``is_valid`` marking the validation rows.

    Trailing windows never look ahead, so features are built over the whole series; with
    ``split_first`` the windows restart at the split date instead.
    """
    targets = [f"h{h}_{target}" for h in range(1, horizon + 1)]
    flagged = snapshot.withColumn("is_valid", F.col("c_date") >= F.lit(split_date).cast("date"))
    filled = forward_fill(flagged, targets)
    keys = (*SERIES, "is_valid") if split_first else SERIES
    return window_features(filled, target, horizon, keys=keys)


def split_by_date(df: DataFrame, split_date: str, day: str = "c_date", last_train_day: bool = False):
    """(train, valid): the split day is valid, or with ``last_train_day`` the last train day."""
    limit = F.lit(split_date).cast("date")
    in_train = F.col(day) <= limit if last_train_day else F.col(day) < limit
    return df.filter(in_train), df.filter(~in_train)


def input_target_dates(matrix: DataFrame, target: str = "log_units_sold", horizon: int = 7):
    """Split a matrix into inputs, targets and dates; all three keep the row key."""
    targets = [f"h{h}_{target}" for h in range(1, horizon + 1)]
    key = [*SERIES, "c_date"]
    return (
        matrix.drop(*targets, "is_valid"),
        matrix.select(*key, *targets),
        matrix.select(*key),
    )


# --- features of the notebook variant -------------------------------------------------------


def weekday_mean(target: str, weeks: int, keys=SERIES, day: str = "c_date") -> Column:
    """Mean of the same weekday over the ``weeks`` weeks before today."""
    return over_days(f"avg({target})", -7 * weeks, -1, (*keys, f"weekday({day})"), day)


def same_day_mean(target: str, years: int, keys=SERIES, day: str = "c_date") -> Column:
    """Mean of the same day-of-year over the ``years`` years before today (start included)."""
    here = F.col(day)
    oldest = F.add_months(here, -12 * years)
    values = []
    for n in range(1, years + 1):
        for gap in range(365 * n, 365 * n + (n + 3) // 4 + 1):
            then = F.date_sub(here, gap)
            same = (F.dayofyear(then) == F.dayofyear(here)) & (F.year(then) == F.year(here) - n)
            found = value_in_days(target, -gap, keys, day)
            values.append(F.when(same & (then >= oldest), found))
    known = F.filter(F.array(*values), lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(total, F.size(known))


def upcoming_count(flag: str, days: int, keys=SERIES, day: str = "c_date") -> Column:
    """How often ``flag`` holds in the ``days`` days after today; 0 when no row lies there."""
    return F.coalesce(over_days(f"sum(int({flag}))", 1, days, keys, day), F.lit(0))


def two_row_min(target: str, keys=SERIES, day: str = "c_date") -> Column:
    """Minimum of this and the previous row; NULL unless both are known."""
    w = rows_of_series(keys, day).rowsBetween(-1, 0)
    return F.when(F.count(target).over(w) == 2, F.min(target).over(w))


def trailing_list(target: str, days: int, keys=SERIES, day: str = "c_date") -> Column:
    """Values of the last ``days`` days, oldest first."""
    rows = over_days(f"collect_list(struct({day} AS d, {target} AS x))", 1 - days, 0, keys, day)
    return F.transform(F.sort_array(rows), lambda r: r["x"])
