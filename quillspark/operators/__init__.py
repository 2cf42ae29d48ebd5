"""Operators on decoded documents: rendering and resolution of display text."""
