"""Column builders and the few Python functions that need them."""
