"""Corpus-preparation operators: ten document, vector and token operators and their queries.

Nothing outside this folder imports it; ``entries`` lists the queries.
"""
