"""Part of the deal-price engine."""
