"""Relational operators over the engine's DataFrames."""
