"""End-to-end plans that chain operators."""
