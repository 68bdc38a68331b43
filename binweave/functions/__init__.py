"""Column expressions: quantizing values to bins, and back."""
