"""Part of the heatgrid engine."""
