"""Read-only SQL over registered views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_READS = re.compile(r"(?is)^\s*(?:--[^\n]*\n|/\*.*?\*/|\s)*(select|with|values|table|from|show|describe|explain)\b")
_WRITES = re.compile(r"(?i)\b(insert|update|delete|merge|drop|alter|create|truncate|load|cache|uncache|refresh|set|reset|add|call|execute|analyze|msck|grant|revoke|overwrite)\b")


def guarded(spark: SparkSession, text: str, limit: int = 1000) -> DataFrame:
    """The first ``limit`` rows of a query; anything but one reading statement is refused."""
    body = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    if not _READS.match(text) or _WRITES.search(body) or ";" in body.strip().rstrip(";"):
        raise ValueError("only a single reading statement is allowed")
    return spark.sql(text.strip().rstrip(";")).limit(limit)


def plan_error(spark: SparkSession, text: str) -> str | None:
    """Why a query cannot be planned, or None; nothing is run."""
    try:
        guarded(spark, text).explain
        return None
    except Exception as e:
        return str(e).split("\n")[0]
