"""Project objects and planning: no Spark here."""
