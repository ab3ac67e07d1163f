"""Column functions with the string semantics the operators share."""
