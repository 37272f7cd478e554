"""The kernels, one module for each, as functions from DataFrames to DataFrames."""
