"""Readers and writers of capture formats."""
