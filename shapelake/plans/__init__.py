"""Round-based plans: cut lineage, iterate to a fixpoint, label connected components."""
