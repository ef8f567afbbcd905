"""DataFrame -> DataFrame operators. All are lazy unless their docstring says otherwise."""
