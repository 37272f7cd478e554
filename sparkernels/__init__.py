"""Spark-native numeric kernels: DataFrame programs for stencils, sorting, clustering, factorisation, search and rendering."""
