"""Tables kept up to date by new rows."""
