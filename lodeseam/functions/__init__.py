"""Part of lodeseam."""
