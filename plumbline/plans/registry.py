"""All registered queries of the library proper, and their SQL."""

from plumbline.plans import evaluation, quality, retrieval

MODULES = (retrieval, evaluation, quality)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
