"""Keyed-state operators: flows, counters, assets, translation tables, matching."""
