from .query import await_rows, rows_seen, start_query

__all__ = ["await_rows", "rows_seen", "start_query"]
