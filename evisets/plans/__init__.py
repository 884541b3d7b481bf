"""Multi-stage jobs assembled from the operators."""
