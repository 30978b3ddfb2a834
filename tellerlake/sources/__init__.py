"""Readers, writers, and the customer table derived from a sales star schema."""
