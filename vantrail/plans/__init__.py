"""Composed plans: the cleaning pipeline and the query registry."""
