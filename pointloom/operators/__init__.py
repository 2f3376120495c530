"""Relational operators over points, regions and edges."""
