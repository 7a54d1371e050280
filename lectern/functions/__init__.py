"""Column functions on text, numbers and bytes."""
