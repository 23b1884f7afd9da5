"""Column expressions (``columns``), aggregate expressions (``aggregates``) and fixed values."""
