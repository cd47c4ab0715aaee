"""lodestone: analytics operators written as Spark plans."""
