"""Column functions: regex dialect, normalizers, rule detectors, numbers, answers."""
