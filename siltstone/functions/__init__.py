"""Scalar functions: addresses, bit arithmetic, kernels that SQL lacks."""
