"""Part of symbolloom; see README.md."""
