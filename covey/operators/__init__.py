"""Relational operators over series(id, name, t, v) and pairs(i, j, rho)."""
