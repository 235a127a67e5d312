"""Operators for preparing language-model training data, as Spark jobs.

Nothing else in the library imports this subpackage. Each module holds one operator with
its general interface; ``catalog`` derives the registered queries from them.
"""
