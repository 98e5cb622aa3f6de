"""Work planning: visibility density, bins, subgrid work."""
