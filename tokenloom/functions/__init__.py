"""Column functions: everything here is a built-in expression and stays in whole-stage code generation or in arrays."""
