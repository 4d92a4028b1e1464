"""Operators for training data: seen keys, groups of matches, frequent values, containers, mixtures, pieces.

Nothing outside this subpackage imports it.
"""
