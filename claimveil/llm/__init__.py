"""Training-data operators: de-duplication, search, filters, mixing, token output.

Nothing outside this folder imports it; ``registry`` lists its queries.
"""
