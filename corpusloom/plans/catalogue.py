"""All queries of the corpus and evaluation operators, with their SQL."""

from __future__ import annotations

from corpusloom.plans import corpus, evaluation, studies

MODULES = (corpus, evaluation, studies)
FLAGSHIP = "form_frequencies"
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
