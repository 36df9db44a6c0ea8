"""Waveform diagnostics and result analytics as Spark DataFrame programs."""
