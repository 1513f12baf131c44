"""Column functions and the few Arrow functions that have no Column form."""
