"""Training-data operators: one module each, registered through ``harrow.llm.registry``."""
