"""Scalar functions as Catalyst expressions, with Arrow functions where no built-in expresses them."""
