"""Column builders: native expressions unless the module says otherwise."""
