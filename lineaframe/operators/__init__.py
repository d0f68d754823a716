"""Plans as DataFrames: execution, lineage, counterfactuals and contributions."""
