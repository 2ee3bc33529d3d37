"""Training-data operators: one module each, registered by ``folioscope.llm.queries``."""
