"""The registered queries and the SQL they are held against."""

from __future__ import annotations

from strandline.plans import relational, statistical, steps

FLAGSHIP = "allele_betaln_by_arm"
QUERIES = {**relational.QUERIES, **statistical.QUERIES, **steps.QUERIES}
ORACLE_SQL = {**relational.ORACLE_SQL, **statistical.ORACLE_SQL, **steps.ORACLE_SQL}
