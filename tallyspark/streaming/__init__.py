"""Structured Streaming forms of two batch flows: sale entry as requests
arrive, and the day-level KPIs kept up to date from the sales stream."""
