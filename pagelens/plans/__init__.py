"""Whole reports, composed of the operators."""
