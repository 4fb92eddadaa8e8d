"""Bookmark lake: captured bookmark-service responses to a searchable table, as Spark jobs."""
