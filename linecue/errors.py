"""What is raised where an input can't be used at all; problems of single rows are rows themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame


class Unusable(ValueError):
    """An input with problems, all of which it lists."""

    def __init__(self, problems: list[str]):
        super().__init__("\n".join(problems))
        self.problems = problems


def usable(rows: DataFrame, problems: DataFrame, most: int = 20) -> DataFrame:
    """rows, or Unusable with the first `most` problems (script_id, line, message)."""
    found = problems.orderBy("script_id", problems["line"].asc_nulls_last(), "message").limit(most).collect()
    if found:
        raise Unusable([f"script {p.script_id}" + (f", line {p.line}" if p.line is not None else "") + f": {p.message}" for p in found])
    return rows
