"""DataFrame operators over records, events, claims and documents."""
