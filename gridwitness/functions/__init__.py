"""Scalar functions: column expressions, and Arrow functions where no expression exists."""
