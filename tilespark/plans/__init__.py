"""The engine and the catalogue of queries."""
