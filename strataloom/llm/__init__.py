"""Operators that prepare source code and prose as training text."""
