"""Part of the lodestar package."""
