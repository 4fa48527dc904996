"""All queries outside the llm subpackage, with their SQL."""

from __future__ import annotations

from . import audit, detection, documents, gateway, identifiers, masking, streams, traffic

MODULES = (detection, identifiers, masking, gateway, traffic, audit, documents, streams)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: _counts(v) for m in MODULES for k, v in m.ORACLE_SQL.items()}


def _counts(sql: str) -> str:
    """count_if(x) as count(*) FILTER (WHERE x): a BIGINT in DuckDB, as in Spark."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + 9, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}(count(*) FILTER (WHERE {sql[at + 9 : end - 1]})){sql[end:]}"
    return sql
