"""Queries over tables, quality gates and the ledger of stages."""
