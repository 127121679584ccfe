"""Compositions of operators: the cleaning pipeline, the facade, the query registry."""
