"""The same operators over unbounded input, with keyed state."""
