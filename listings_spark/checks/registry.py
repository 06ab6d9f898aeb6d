"""All registered queries and their SQL twins."""

from __future__ import annotations

from listings_spark.checks import (
    collect_checks,
    directory_checks,
    lifecycle_checks,
    listing_checks,
    page_checks,
    registry_checks,
    state_checks,
)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

for _module in (
    listing_checks, directory_checks, registry_checks, collect_checks, lifecycle_checks,
    page_checks, state_checks,
):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
