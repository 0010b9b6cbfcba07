"""Relational operators: transform (P), merge (J), versions (V, M2),
governance (G), checks and reports (A, R), maintenance planning (M1)."""
