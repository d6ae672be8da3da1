"""Relational operators over images, tiles and byte streams."""
