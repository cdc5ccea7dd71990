"""Plans: the workspace's queries, document processing, and the queries over supplied tables."""
