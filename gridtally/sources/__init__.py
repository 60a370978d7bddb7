"""File discovery and CSV reading."""
