"""Operators: indexes, entities, reference graphs, key sets, trees, contents."""
