"""All queries of the library's own operators and their SQL twins."""

from . import catalog_chain, catalog_data, catalog_decide, catalog_edits, catalog_people, catalog_rank, catalog_review, catalog_sources

QUERIES = catalog_rank.QUERIES | catalog_people.QUERIES | catalog_data.QUERIES | catalog_decide.QUERIES | catalog_review.QUERIES | catalog_sources.QUERIES | catalog_chain.QUERIES | catalog_edits.QUERIES
ORACLE = catalog_rank.SQLS | catalog_people.SQLS | catalog_data.SQLS | catalog_decide.SQLS | catalog_review.SQLS | catalog_sources.SQLS | catalog_chain.SQLS | catalog_edits.SQLS
