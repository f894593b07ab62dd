"""Audit of question-answering conversations, and preparation of training text, as Spark jobs."""
