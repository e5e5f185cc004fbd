"""Operators over readings and day frames."""
