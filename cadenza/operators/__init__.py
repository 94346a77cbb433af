"""Operators on keyed, ordered series. None knows what the series measures."""
