"""Report date frames, as Columns, so that literal parameters fold into constants."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import date_literal


class QuarterFrame(NamedTuple):
    """First and last day of the quarter before a date, and a year earlier."""

    start: Column
    end: Column
    py_start: Column
    py_end: Column


class EvalFrame(NamedTuple):
    """Evaluation date, a year earlier, and the quarter and years to report."""

    eval_date: Column
    py_eval_date: Column
    quarter: Column
    year: Column
    previous_year: Column


class OpenFrame(NamedTuple):
    """Open intervals around the quarter before a date, and a year earlier."""

    cy_start: Column
    cy_end: Column
    py_start: Column
    py_end: Column


class FrameLabels(NamedTuple):
    cy_start: Column
    cy_end: Column
    py_start: Column
    py_end: Column


class CalendarNumbers(NamedTuple):
    quarter: Column
    previous_quarter: Column
    year: Column
    previous_year: Column


def today(as_of=None) -> Column:
    return F.current_date() if as_of is None else date_literal(as_of)


def year_earlier(day: Column) -> Column:
    return F.add_months(day, -12)


def quarter_frame(as_of=None) -> QuarterFrame:
    this_quarter = F.trunc(today(as_of), "quarter")
    start, end = F.add_months(this_quarter, -3), F.date_sub(this_quarter, 1)
    return QuarterFrame(start, end, year_earlier(start), year_earlier(end))


def eval_frame(eval_date) -> EvalFrame:
    day = date_literal(eval_date)
    return EvalFrame(day, year_earlier(day), F.quarter(day), F.year(day), F.year(day) - 1)


def open_frame(as_of=None) -> OpenFrame:
    this_quarter = F.trunc(today(as_of), "quarter")
    start = F.date_sub(F.add_months(this_quarter, -3), 1)
    return OpenFrame(start, this_quarter, year_earlier(start), year_earlier(this_quarter))


def frame_labels(frame: OpenFrame) -> FrameLabels:
    """Month and year of the first and last day inside each open interval."""

    def text(day: Column) -> Column:
        return F.date_format(day, "MMM yyyy")

    return FrameLabels(
        text(F.date_add(frame.cy_start, 1)),
        text(F.date_sub(frame.cy_end, 1)),
        text(F.date_add(frame.py_start, 1)),
        text(F.date_sub(frame.py_end, 1)),
    )


def calendar_numbers(as_of=None) -> CalendarNumbers:
    day = today(as_of)
    before = F.date_sub(F.trunc(day, "quarter"), 1)
    return CalendarNumbers(F.quarter(day), F.quarter(before), F.year(day), F.year(day) - 1)
