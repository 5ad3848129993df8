"""Detection, model, provenance, shift and fusion operators over DataFrames."""
