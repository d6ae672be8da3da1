"""Readers and writers of image and map files."""
