"""Column expressions: parsing, agreement, rules, sentiment."""
