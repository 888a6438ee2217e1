"""From text to DataFrames: lexer, parser, binder; and cost estimates."""
