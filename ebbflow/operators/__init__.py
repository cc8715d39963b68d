"""DataFrame operators, one module per family of analyses."""
