"""Expression helpers."""
