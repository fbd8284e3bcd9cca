"""Training-data operators: one module per operator, Spark jobs throughout.

Nothing outside this folder imports it; ``queries.py`` lists its queries.
"""
