"""Pieces of the SQL that checks the jobs."""

from __future__ import annotations

from ..functions.text import WS
from . import views


def using(names: str, sql: str) -> str:
    """sql with the named views in front. sql starts with SELECT, or with further common tables behind a comma."""
    ctes = ",\n".join(f"{n} AS ({views.SQL[n]})" for n in names.split())
    return f"WITH {ctes}\n{sql}"


def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{WS}+|{WS}+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex(coalesce({x}, ''), '{WS}+'), lambda w: w <> '')"
