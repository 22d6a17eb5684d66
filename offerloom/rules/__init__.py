"""Rule tables. Everything here is a fixed value that results depend on."""
