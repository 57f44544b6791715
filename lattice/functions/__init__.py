"""Expressions: element types with exact width."""
