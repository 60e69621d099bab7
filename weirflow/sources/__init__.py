"""Readers of packet views, rule files and signature files."""
