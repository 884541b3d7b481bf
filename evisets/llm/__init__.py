"""Operators of a training-data pipeline. Each module keeps one operator; ``queries`` registers them on the given tables."""
