"""From raw documents to a training mix: the stages of visigraph.llm.pipeline, applied to the table documents.

SQL can't express the classifier and the near-duplicates, so ORACLE_SQL is None and the stages are tested against brute force.
"""

from visigraph.llm.pipeline import STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
ORACLE_SQL = None
