"""Part of tracery."""
