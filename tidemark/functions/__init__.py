"""Column expressions for paths, quantities, configuration maps and versions."""
