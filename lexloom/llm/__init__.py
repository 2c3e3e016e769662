"""Training-data operators: self-contained, nothing outside this subpackage imports it."""
