"""See the package docstring of quarrylens."""
