"""The registered queries of the corpus operators and the SQL of those that SQL can express."""

from maskquery.llm import conversations, decontamination, disclosure, embedding_dup, html_text, language, line_dedup, lm_score, near_dup, quality, search, subwords, token_store

_MODULES = (lm_score, language, subwords, html_text, near_dup, token_store, decontamination, line_dedup, quality, embedding_dup, conversations, disclosure, search)
QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
