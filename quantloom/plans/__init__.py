"""Registered queries: panel adapters over the driver's tables, operators on them, and their DuckDB SQL."""
