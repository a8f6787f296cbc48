"""Sources of nodes, edges and staging rows."""
