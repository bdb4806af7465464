"""Operators for large-scale training data; nothing else in the package imports this one."""
