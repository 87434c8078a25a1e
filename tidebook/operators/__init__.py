"""Relational operators over bars, predictions, positions and journals."""
