"""Operators of the waveform diagnostics."""
