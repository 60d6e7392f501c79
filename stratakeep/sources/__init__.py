"""Stores, command logs and snapshots."""
