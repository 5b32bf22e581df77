"""Complete logical plans composed from the operators."""
