"""Stateful operators on streams, sharing their steps with the batch versions."""
