"""Tables kept up to date over streams of rows."""
