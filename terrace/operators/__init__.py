"""Relational, sequence, spatial and graph operators: DataFrame in, DataFrame out."""
