"""The batch operators that follow a capture in time, over unbounded input."""
