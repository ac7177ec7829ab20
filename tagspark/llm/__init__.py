"""Operators that turn the tag texts of a media library into training data."""
