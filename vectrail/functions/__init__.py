"""Column functions on vectors, bits, bytes and text."""
