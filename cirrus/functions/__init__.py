"""Column -> Column expressions: display formatting and labels (display),
three-valued status (status), and time parsing, formatting and periods (timefn)."""
