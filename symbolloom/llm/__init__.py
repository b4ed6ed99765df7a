"""Training-data operators over text; nothing outside this subpackage imports it."""
