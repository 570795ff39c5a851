"""Readers for uploads, stored tables and the supplied sample tables."""
