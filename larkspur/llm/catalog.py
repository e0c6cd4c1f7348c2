"""The queries of this subpackage and their SQL."""

from . import counts, decontaminate, lines, minhash, mixing, pii, quality, sharding, substring, toxicity

MODULES = (substring, pii, minhash, mixing, toxicity, counts, sharding, decontaminate, lines, quality)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
