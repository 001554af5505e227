"""Rules and how they become DataFrame plans."""
