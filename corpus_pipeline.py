"""The corpus pipeline's stages; each is written and read again by the next."""

from sigloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
