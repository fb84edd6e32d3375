"""Registered queries over the driver tables, with the SQL that must give the same rows."""

from __future__ import annotations

from . import citations, corpus, evidence, extensions, feeds, governance, identity, integrity, lineage, parsed, records, rules, sources, verdicts

QUERIES: dict = {**corpus.QUERIES, **evidence.QUERIES, **sources.QUERIES, **records.QUERIES, **integrity.QUERIES, **governance.QUERIES, **extensions.QUERIES, **identity.QUERIES, **parsed.QUERIES, **lineage.QUERIES, **feeds.QUERIES, **rules.QUERIES, **verdicts.QUERIES, **citations.QUERIES}
ORACLE_SQL: dict[str, str] = {**corpus.ORACLE_SQL, **evidence.ORACLE_SQL, **sources.ORACLE_SQL, **records.ORACLE_SQL, **integrity.ORACLE_SQL, **governance.ORACLE_SQL, **extensions.ORACLE_SQL, **identity.ORACLE_SQL, **parsed.ORACLE_SQL, **lineage.ORACLE_SQL, **feeds.ORACLE_SQL, **rules.ORACLE_SQL, **verdicts.ORACLE_SQL, **citations.ORACLE_SQL}
