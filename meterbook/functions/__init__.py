"""Column expressions: token arithmetic, time parts, labels, identities."""
