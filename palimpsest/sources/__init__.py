"""Sources: files by format, and the editable spans of their texts."""
