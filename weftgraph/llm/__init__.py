"""Operators for large training-text pipelines; nothing else in the package imports this one."""
