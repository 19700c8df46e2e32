"""Relational, spatial, temporal and scoring operators."""
