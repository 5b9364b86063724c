"""Simulation models and the registry of queries."""
