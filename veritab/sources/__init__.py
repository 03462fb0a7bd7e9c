"""Records, contracts and evidence files."""
