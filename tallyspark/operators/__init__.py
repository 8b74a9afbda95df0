"""The named operators, grouped by page area."""
