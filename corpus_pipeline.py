"""From raw documents to packed sequences; the stages are those of papyra.llm.pipeline."""

from papyra.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
