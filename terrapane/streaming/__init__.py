"""Incremental registry upkeep."""
