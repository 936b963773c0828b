"""Column functions: texts, media records, derived fields."""
