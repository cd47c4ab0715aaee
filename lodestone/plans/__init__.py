"""plans of lodestone."""
