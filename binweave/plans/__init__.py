"""Fitting, encoding, pushdown and the refresh planner."""
