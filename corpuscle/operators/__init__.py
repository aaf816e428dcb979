"""Operators on DataFrames: segmentation, alignment, grading, selection, repair, measures, reference data."""
