"""Training-data operators.  Self-contained: no other subpackage imports it."""
