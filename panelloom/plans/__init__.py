"""Whole studies and jobs composed of operators."""
