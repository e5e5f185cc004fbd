"""Composed plans: findings, insights, and the registered queries."""
