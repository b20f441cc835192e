"""Part of corvane."""
