"""Compositions of operators: the batch worker path, the metrics page, and the query catalogue."""
