"""The corpus pipeline: quality, line dedup, near dedup, decontamination, tokens; its stages are in the optional folder."""

from quarry.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
