"""Plans of the waveform diagnostics."""
