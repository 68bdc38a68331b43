"""Filters, histograms, reductions, ranking, deltas, indexes and derived queries over encoded tables."""
