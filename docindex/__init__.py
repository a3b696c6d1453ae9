"""Spark jobs that turn pages, documents and source projects into a searchable
corpus and questions into grounded prompts."""
