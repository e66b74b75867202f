"""Text operators for building training data from the engine's document-like records.

Each operator is a module of its own; ``queries`` applies them to the given tables. Nothing
outside this folder imports it.
"""
