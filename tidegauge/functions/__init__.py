"""Part of tidegauge."""
