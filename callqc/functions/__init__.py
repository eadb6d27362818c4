"""Column builders shared by the operators (filters, scoring, JSON, page arithmetic)."""
