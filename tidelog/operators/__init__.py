"""Operators over the log, timelines, folds and texts."""
