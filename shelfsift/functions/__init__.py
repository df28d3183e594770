"""Column expressions: parsing, text analysis, predicates and display formats."""
