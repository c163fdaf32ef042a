"""Training-data operators: ten self-contained corpus operators and their registered queries."""
