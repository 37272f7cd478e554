"""Column expressions that several kernels share."""
