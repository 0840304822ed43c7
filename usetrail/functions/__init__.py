"""Column-level building blocks: fixed rule values and expressions."""
