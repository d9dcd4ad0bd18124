"""Column functions: scalar math, rates and model kernels."""
