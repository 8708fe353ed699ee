"""All queries of the subpackage, with their SQL."""

from . import ann, centroids, decontaminate, divergence, html, jaccard, mixing, paragraphs, pii, quality, suffix, toxicity, urls

MODULES = (ann, quality, html, mixing, toxicity, pii, decontaminate, jaccard, suffix, paragraphs, urls, centroids, divergence)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
