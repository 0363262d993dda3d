"""Part of quillmark."""
