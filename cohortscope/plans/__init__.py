"""Periods, size-checked broadcast, plan checks and the named query set."""
