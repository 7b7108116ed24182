"""Column expressions and small builders shared by the operators."""
