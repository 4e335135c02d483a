"""Training-data operators: one module per operator, registered by ``queries``."""
