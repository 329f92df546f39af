"""Bars, indicators and strategy simulation as Spark plans."""
