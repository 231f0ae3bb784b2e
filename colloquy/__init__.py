"""Conversation analytics on Spark: DataFrame-first operators, sources, plans and streams."""
