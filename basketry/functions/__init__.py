"""Column expressions: coercion, calendar, text and ratios."""
