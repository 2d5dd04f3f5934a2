"""Column expressions; everything here stays inside whole-stage codegen unless
the docstring says otherwise."""
