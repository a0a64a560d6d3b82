"""Column functions and fixed lookup values."""
