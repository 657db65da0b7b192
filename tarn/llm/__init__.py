"""Training-data operators: one module per operator, each usable on its own.

Nothing outside this subpackage imports it; ``queries.py`` lists the
registered queries and their SQL.
"""
