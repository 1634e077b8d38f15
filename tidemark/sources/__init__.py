"""Readers that give the shapes the operators take."""
