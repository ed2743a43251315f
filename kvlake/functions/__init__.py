"""Part of kvlake; see README.md."""
