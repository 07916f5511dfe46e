"""See the package docstring of :mod:`tesserae`."""
