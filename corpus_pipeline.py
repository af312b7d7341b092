"""From raw documents to packed training sequences, stage by stage.

quality: documents that the classifier rejects go. lines: lines shared by ten or more documents go.
near_copies: one document of each group of like ones stays. secrets: secrets are masked. packing: the
token ids of what is left, in sequences of 1,024.
"""

from asterism.llm.stages import STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

# The classifier cannot be said in SQL; tests hold every stage against plain Python.
ORACLE_SQL = None
