"""Column-level functions: operators, reducers, components, geometry."""
