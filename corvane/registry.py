"""All queries of the retrieval engine, and the SQL each is compared with."""

from __future__ import annotations

from corvane.plans import answers, base, collection, evaluation, features, fusion, indexed, lanes, maintenance, protocol, state, surface, versions  # noqa: F401  the modules register their queries


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
