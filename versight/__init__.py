"""versight: text-evidence analytics as DataFrame plans."""
