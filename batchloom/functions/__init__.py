"""Column expressions: strict JSON fields, canonical text, containment, display and log fields."""
