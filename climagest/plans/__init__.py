"""Whole calculations from input files to output files."""
