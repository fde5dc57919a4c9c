"""Registry of queries by name, with their oracle SQL where SQL can express them."""

from . import analysis_queries, cluster_queries, library_queries, merge_queries, note_queries, point_queries, price_queries, publish_queries, report_queries, shelf_queries, source_queries, stream_queries, text_queries, vector_queries, wishlist_queries

MODULES = [price_queries, library_queries, wishlist_queries, vector_queries, source_queries, shelf_queries, text_queries, point_queries, merge_queries, analysis_queries, cluster_queries, publish_queries, report_queries, stream_queries, note_queries]
QUERIES: dict = {k: f for m in MODULES for k, f in m.Q.items()}
ORACLE_SQL: dict = {k: s for m in MODULES for k, s in m.S.items()}
FLAGSHIP = "j02_latest_price"
