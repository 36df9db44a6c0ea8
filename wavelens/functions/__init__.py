"""Functions of the waveform diagnostics."""
