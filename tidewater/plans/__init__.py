"""From SQL text to a logical plan: types, catalogue, syntax, binding, row-level security, estimates."""
