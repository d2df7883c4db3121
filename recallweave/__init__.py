"""Conversation-memory retrieval on Spark: clean, segment, index, rank, remember and pack messages as DataFrames."""
