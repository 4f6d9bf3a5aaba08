"""Composed pipelines and the scratch space they materialise into."""
