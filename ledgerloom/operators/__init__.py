"""Relational operators on ticks, positions, intervals and decisions."""
