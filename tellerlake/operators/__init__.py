"""Analyses over the customer table and its projections."""
