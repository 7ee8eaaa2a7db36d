"""The corpus pipeline: five stages, each a table that is written and read again (see ``foliant.llm.stages``).

SQL can't express the hashed likelihood ratio and the bit-sampled search; tests
hold each stage against a plain version.
"""

from foliant.llm.stages import STAGES, run

ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
