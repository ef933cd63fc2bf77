"""Dates: ISO text in UTC and HTTP dates."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_utc(text: str) -> str:
    """``text`` as ``yyyy-MM-ddTHH:mm:ss.SSSZ``; a date or time without a zone counts as UTC.

    A year or a month alone means its first day.
    """
    text = text.strip()
    if re.fullmatch(r"\d{4}(-\d{2})?", text):
        text += "-01-01"[len(text) - 4:]
    moment = datetime.fromisoformat(text)
    moment = moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment.astimezone(timezone.utc)
    return moment.strftime("%Y-%m-%dT%H:%M:%S.") + f"{moment.microsecond // 1000:03d}Z"


def iso_text(moment: Column) -> Column:
    """Column form of :func:`iso_utc`; the session time zone is taken to be UTC."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def http_date(text: Column) -> Column:
    """``Sat, 01 Jan 2022 00:00:00 GMT`` as a timestamp, NULL if it has another form."""
    day_on = F.regexp_extract(text, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1)
    return F.try_to_timestamp(F.nullif(day_on, F.lit("")), F.lit("dd MMM yyyy HH:mm:ss"))
