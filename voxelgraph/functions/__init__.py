"""Column functions and Arrow batch functions on series."""
