"""Operators for preparing training corpora at scale. Nothing else in the package imports this one."""
