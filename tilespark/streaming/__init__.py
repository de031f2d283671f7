"""Tiles over streams."""
