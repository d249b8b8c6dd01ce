"""Operators on panels: signals, filters, sorts, holding, inference, factors."""
