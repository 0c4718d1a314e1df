"""Pastes that arrive over time."""
