"""Column functions: text rules and vector arithmetic of native expressions; stand-in encoders run in Arrow batches."""
