"""The registered queries and the SQL each is checked against."""

from __future__ import annotations

from cohortlens.catalog.base import ORACLES, QUERIES


def load() -> tuple[dict, dict]:
    from cohortlens.catalog import (  # noqa: F401
        clustering, counterfactuals, explaining, local, preparation, profiling, projecting, validation,
    )

    return QUERIES, ORACLES
