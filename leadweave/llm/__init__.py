"""Operators for preparing training text: one module each, by the method its docstring names."""
