"""Readers and writers of the back-office tables, and the adapter that maps the
driver's test tables onto them."""

from tallyspark.sources.tables import (  # noqa: F401
    ShopTables, canonical_status, conform, read_tables, write_table,
)
