"""Column functions and the ordered scan shared by the operators."""
