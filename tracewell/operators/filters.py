"""Composable row filters: a registry maps a resource's keys to predicates.

A list of (key, value) pairs is ANDed.  An unknown key is an error, a missing value is the empty text.
"Contains" filters ignore case and know no wildcards.  Time bounds on runs are strict, those on datasets
inclusive; both accept `01 Jan 2017 13:45`.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Predicate = Callable[[str], Column]
#: A filter that needs another table.
Relation = Callable[[str], Callable[[DataFrame], DataFrame]]


def contains(*columns: str) -> Predicate:
    """Any of the columns has the value as a part, in any case."""
    return lambda v: reduce(lambda a, b: a | b, (F.contains(F.lower(F.col(c)), F.lit(v.lower())) for c in columns))


def equals(column: str, kind: str = "long") -> Predicate:
    return lambda v: F.col(column) == F.lit(v).try_cast(kind)


def parse_date(value: str) -> Column:
    """Day, month name, year, hour and minute; null if it isn't that."""
    return F.try_to_timestamp(F.lit(value), F.lit("dd MMM yyyy H:mm"))


def bound(column: str, side: str, inclusive: bool) -> Predicate:
    """After or before a time; strict unless inclusive."""

    def make(v: str) -> Column:
        c, t = F.col(column).cast("timestamp"), parse_date(v)
        return {("after", False): c > t, ("before", False): c < t, ("after", True): c >= t, ("before", True): c <= t}[side, inclusive]

    return make


def any_state(column: str) -> Predicate:
    """The state is one of the letters of the value, in any case."""
    return lambda v: F.col(column).isin(*v.upper()) if v else F.lit(False)


def active(end: str, as_of: Column, minutes: int = 5) -> Predicate:
    """Not ended, or ended within the last minutes."""
    return lambda v: F.col(end).isNull() | (F.col(end) >= as_of - F.expr(f"interval {minutes} minutes"))


def using(edges: DataFrame) -> Relation:
    """The run used the dataset of that id as an input (edges: run, dataset, kind)."""

    def make(v: str) -> Callable[[DataFrame], DataFrame]:
        found = edges.where((F.col("kind") == "I") & (F.col("dataset") == F.lit(v).try_cast("long"))).select(F.col("run").alias("id"))
        return lambda df: df.join(found, "id", "left_semi")

    return make


NAMED: Mapping[str, Predicate] = {"smart": contains("name", "description"), "name": contains("name"), "description": contains("description")}
FAMILY_FILTERS: Mapping[str, Predicate] = {**NAMED, "smart": contains("name", "git", "description"), "git": contains("git"), "user": contains("owner_name")}
CHOICE_FILTERS: Mapping[str, Predicate] = {"smart": contains("name", "description"), "family": contains("name"), "family_desc": contains("description")}
CONTAINER_FILTERS: Mapping[str, Predicate] = {
    "family_id": equals("family_id"),
    "smart": contains("tag", "description"),
    "tag": contains("tag"),
    "description": contains("description"),
    "user": contains("owner_name"),
}
APP_FILTERS: Mapping[str, Predicate] = {**NAMED, "container_id": equals("container_id")}
ARGUMENT_FILTERS: Mapping[str, Predicate] = {"app_id": equals("app_id"), "name": contains("name")}
BATCH_FILTERS: Mapping[str, Predicate] = NAMED
DIRECTORY_FILTERS: Mapping[str, Predicate] = {"smart": contains("name", "path"), "name": contains("name"), "path": contains("path")}
RUN_FILTERS: Mapping[str, Predicate] = {
    **NAMED,
    "user": contains("owner_name"),
    "batch": contains("batch_name"),
    "batchdesc": contains("batch_description"),
    "states": any_state("state"),
    "startafter": bound("submitted", "after", False),
    "startbefore": bound("submitted", "before", False),
    "endafter": bound("ended", "after", False),
    "endbefore": bound("ended", "before", False),
    "owner_id": equals("owner"),
    "app_id": equals("app_id"),
    "batch_id": equals("batch_id"),
}
DATASET_FILTERS: Mapping[str, Predicate] = {
    **NAMED,
    "user": contains("owner_name"),
    "uploaded": lambda v: F.col("uploaded"),
    "md5": lambda v: F.col("md5") == v,
    "createdafter": bound("created", "after", True),
    "createdbefore": bound("created", "before", True),
}


def run_filters(edges: DataFrame, now: Column | None = None) -> Mapping[str, Predicate | Relation]:
    """RUN_FILTERS with those that need the runs' inputs and the time."""
    return {**RUN_FILTERS, "input_id": using(edges), "active": active("ended", F.current_timestamp() if now is None else now)}


def date_presets(now: Column) -> dict[str, Column]:
    """The starts of the usual spans up to `now`, by name."""
    day = F.date_trunc("day", now)
    back = {"last_30_minutes": "30 minutes", "last_hour": "1 hour", "last_day": "1 day"}
    return {
        **{name: now - F.expr(f"interval {span}") for name, span in back.items()},
        "last_week": day - F.expr("interval 7 days"),
        # A month back ends with the shorter month.
        "month_ago": now - F.expr("interval 1 month"),
        "year_ago": now - F.expr("interval 1 year"),
        "today": day,
        "this_week": F.date_trunc("week", now),
        "this_month": F.date_trunc("month", now),
        "this_year": F.date_trunc("year", now),
    }


class FilterSet:
    """An ordered list of filters without repeats, with a text form `key=value&...`."""

    def __init__(self, pairs: Sequence[tuple[str, str]] = ()):
        self.pairs: list[tuple[str, str]] = []
        for key, value in pairs:
            self.add(key, value)

    def add(self, key: str, value: str = "") -> FilterSet:
        if (key, value) not in self.pairs:
            self.pairs.append((key, value))
        return self

    def remove(self, key: str, value: str | None = None) -> FilterSet:
        self.pairs = [p for p in self.pairs if p[0] != key or (value is not None and p[1] != value)]
        return self

    def __str__(self) -> str:
        from urllib.parse import urlencode

        return urlencode(self.pairs)

    @classmethod
    def parse(cls, text: str) -> FilterSet:
        from urllib.parse import parse_qsl

        return cls(parse_qsl(text, keep_blank_values=True))


def numbered(params: Mapping[str, str]) -> list[tuple[str, str]]:
    """filters[n][key] and filters[n][val] for n = 0, 1, ... up to the first gap."""
    out: list[tuple[str, str]] = []
    while (key := params.get(f"filters[{len(out)}][key]")) is not None:
        out.append((key, params.get(f"filters[{len(out)}][val]", "")))
    return out


def apply(df: DataFrame, pairs: Sequence[tuple[str, str]], registry: Mapping[str, Predicate | Relation]) -> DataFrame:
    unknown = [k for k, _ in pairs if k not in registry]
    if unknown:
        raise KeyError(f"unknown filter key: {unknown[0]}")
    made = (registry[k](v) for k, v in pairs)
    return reduce(lambda d, f: d.filter(f) if isinstance(f, Column) else f(d), made, df)
