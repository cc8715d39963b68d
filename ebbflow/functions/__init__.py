"""Column functions: hydrological calendar and special functions."""
