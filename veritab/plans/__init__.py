"""Plan builders and the query catalogue."""
