"""Part of filingloom."""
