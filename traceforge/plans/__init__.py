"""Jobs that chain operators from recordings to campaign results."""
