"""The same detectors on arriving files."""
