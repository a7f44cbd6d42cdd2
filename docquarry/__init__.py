"""docquarry: document analytics and retrieval as Spark DataFrame transforms."""
