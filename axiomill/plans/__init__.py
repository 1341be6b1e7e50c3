"""Rules, fixpoint and integrity checks."""
