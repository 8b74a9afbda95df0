"""Compositions of operators: page loads, batch jobs, exports, and the
registered queries used by the driver."""
