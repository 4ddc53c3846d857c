"""Scheduled refresh: ask again for indexed files that changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.fixed_values import REFRESH_PERIOD
from docloom.operators import index
from docloom.sources import messages


def refresh(
    content: DataFrame,
    files: DataFrame,
    message_folder: str,
    now: Column | None = None,
    period: str = REFRESH_PERIOD,
) -> None:
    """One run of the periodic job; a scheduler calls it once per period."""
    at = F.current_timestamp() if now is None else now
    messages.publish(index.refresh_requests(content, files, at, period), message_folder)
