"""Operators over long panels: DataFrames keyed by (date, id)."""
