"""Table verbs as functions of DataFrames."""
