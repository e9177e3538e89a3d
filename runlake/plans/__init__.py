"""Jobs made of several operators: medallion layers and the knowledge base."""
