"""Package of operators."""
