"""Training-data operators.  Nothing outside this folder, its tests and the
driver entry imports it."""
