"""Training-data operators.  Nothing else in gaugeworks imports this subpackage."""
