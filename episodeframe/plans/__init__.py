"""Curricula, decomposition, environments, simulation and control."""
