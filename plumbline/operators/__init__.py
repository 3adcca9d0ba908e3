"""DataFrame operators: each is `f(df, ..., keys) -> DataFrame`."""
