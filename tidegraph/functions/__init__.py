"""Column functions: scalar features and checks."""
