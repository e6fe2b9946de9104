"""Structured Streaming forms of the counts; an extension beside the batch queries."""
