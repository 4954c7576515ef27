"""Part of meshlark; see README.md."""
