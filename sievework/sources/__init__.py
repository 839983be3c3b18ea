"""Readers: file listings, the feature store, saved projects, reference labels."""
