"""Column functions and small vectorised kernels."""
