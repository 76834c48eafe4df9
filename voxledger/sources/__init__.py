"""Readers and writers around the raw contract and the feedback table."""
