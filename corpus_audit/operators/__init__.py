"""DataFrame operators: detectors, metrics, profiles, roll-ups and key governance."""
