"""List requests compiled to plans, and the registered queries."""
