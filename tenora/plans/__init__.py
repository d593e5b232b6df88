"""Session settings and the shared folder where jobs cut their lineage."""
