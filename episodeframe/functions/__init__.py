"""Column macros (``columns``) and driver-side numerics (``special``)."""
