"""Compositions of operators: the engine facade, context building, schema evolution."""
