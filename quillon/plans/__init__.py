"""Bindings of the driver's tables to this library's inputs, and the registered queries."""
