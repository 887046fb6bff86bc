"""Column expressions: JSON payload access and field normalisation."""
