"""Project readers and writers, table resolution, catalog seeding."""
