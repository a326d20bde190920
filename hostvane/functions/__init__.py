"""Column expressions and small driver-side rules."""
