"""Operators for training data: text cleaning, duplicates, linkage, leakage, mixing and personal information."""
