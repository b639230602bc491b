"""Schemas, generators and loaders of the research datasets."""
