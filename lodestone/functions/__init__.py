"""functions of lodestone."""
