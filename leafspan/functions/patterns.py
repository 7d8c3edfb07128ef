"""Patterns of dates, codes and exceptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
DATES = (r"^\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}[,.]?$", r"^\d{4}-\d{2}-\d{2}$")
CODES = (r"^\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}$", r"^\d{3}-\d{2}-\d{4}$", r"^\d{5,}$", r"^[A-Z]{1,3}\d{4,}$", r"^\d{7}$")
EXCEPTIONS = (r"^\d{1,2}:\d{2}$", r"^\$[\d,]+\.?\d*$", r"^\d+\.?\d*%$", r"(?i)^(AM|PM|ID|MRN|DOB|SSN|EIN)$")


def matches(t: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | t.rlike(p)
    return out
