"""Divergences, kernels and kernel machines over bags of vectors, as Spark jobs."""
