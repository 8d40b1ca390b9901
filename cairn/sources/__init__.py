"""Binary formats of maps and streams."""
