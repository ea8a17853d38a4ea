"""The queries of the search-visibility jobs and the SQL that gives the same rows."""

from . import audits, graphs, metrics

FLAGSHIP = "page_score_by_project"
_ALL = {**audits.JOBS, **metrics.JOBS, **graphs.JOBS}
QUERIES = {name: job for name, (job, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
