"""DataFrame-to-DataFrame operators. None of them returns collected rows."""
