"""Compositions: one function per dashboard or job request."""
