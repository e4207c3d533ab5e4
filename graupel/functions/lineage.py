"""Where a column's values come from, kept in the columns' own metadata.

Values observed in the window of an event describe the event, so no model may learn from them.  Reducers that
make such columns tag them; Spark carries the tag through renaming, joins, filters and stored tables, and ``passed_on``
carries it through operators that make new columns.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

ORIGIN, EVENT = "origin", "event window"


def of_event(value: Column, name: str) -> Column:
    """The value under a name, tagged as seen in the event's window."""
    return value.alias(name, metadata={ORIGIN: EVENT})


def event_columns(df: DataFrame) -> set[str]:
    """Columns with values of the event's window."""
    return {f.name for f in df.schema.fields if f.metadata.get(ORIGIN) == EVENT}


def passed_on(out: DataFrame, source: DataFrame, made: dict[str, Iterable[str]] | None = None) -> DataFrame:
    """``out`` with the tags of ``source``: of columns of the same name, and of those that ``made`` says each column comes from."""
    tagged = event_columns(source)
    names = [c for c in out.columns if c in tagged or tagged.intersection((made or {}).get(c, ()))]
    return out.select(*[of_event(F.col(c), c) if c in names else F.col(c) for c in out.columns]) if names else out


def require_no_event_signal(df: DataFrame, columns: list[str]) -> None:
    """Predictors may not hold values of the event's window, whatever they are called now."""
    if found := event_columns(df).intersection(columns):
        raise ValueError(f"predictors hold signals of the event window: {sorted(found)}")
